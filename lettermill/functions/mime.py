"""Mail as columns: header fields, parameters, address lists, encoded words, and the tree of a message's parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from lettermill.functions import octets
from lettermill.functions.text import trimmed, unfold

# Bounds of what is read of one message.
MAX_HEADER, MAX_BODY, MAX_PARTS, MAX_DEPTH, MAX_ADDRESSES = 256 << 10, 2 << 20, 64, 8, 256

#: More than any text has characters.
MAX_LENGTH = (1 << 31) - 1

ADDRESS = "struct<name: string, email: string, domain: string>"
_MARK = "struct<node: string, at: int>"
_NODE = f"struct<final: boolean, source: string, path: string, marks: array<{_MARK}>, kind: string, encoding: string, charset: string, filename: string, type: string, size: bigint>"
_FILE = StructType().add("filename", StringType()).add("contentType", StringType()).add("size", LongType())
_FOUND = StructType().add("text", StringType()).add("html", StringType()).add("attachments", ArrayType(_FILE))


def _let(value: Column, f) -> Column:
    """``f`` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# --- header fields ------------------------------------------------------------


def empty_line(source: Column) -> Column:
    """Where the first empty line begins (in characters), with the end of the line before it; 0 without one."""
    found = lambda x: F.nullif(F.instr(source, x), F.lit(0))
    at = F.coalesce(F.least(found("\n\n"), found("\n\r\n")), F.when(source.isNotNull(), F.lit(0)))
    return _let(at, lambda i: F.when(i > 0, i - F.when(F.substring(source, F.greatest(i - 1, F.lit(1)), F.lit(1)) == "\r", 1).otherwise(0)).otherwise(i))


def head_and_body(source: Column) -> Column:
    """The unfolded header block (so much of it as counts) and what comes after the first empty line."""
    rest = lambda i: F.substring(source, i, MAX_LENGTH)
    return _let(
        empty_line(source),
        lambda i: F.struct(
            unfold(F.substring(F.when(i > 0, F.substring(source, F.lit(1), i - 1)).otherwise(source), 1, MAX_HEADER)).alias("head"),
            F.when(i > 0, rest(i + F.length(F.regexp_extract(F.substring(source, i, F.lit(4)), r"\A\r?\n\r?\n", 0)))).otherwise("").alias("body"),
        ),
    )


def named(head: Column) -> Column:
    """The lines of an unfolded header block, and the name before each one's colon (null without one)."""
    name = lambda x: F.when(F.instr(x, ":") > 0, F.translate(F.btrim(F.substring_index(x, ":", 1), F.lit("\t\v\f\r ")), _UPPER, _UPPER.lower()))
    return _let(F.split(head, "\n"), lambda lines: F.struct(lines.alias("lines"), F.transform(lines, name).alias("names")))


#: Letters of header names.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(lines: Column, name: str) -> Column:
    """The first value of a field among ``named`` lines, empty without one."""
    line = lambda at: F.get(lines["lines"], (at - 1).cast("int"))
    value = lambda at: F.when(at > 0, trimmed(F.substring(line(at), F.instr(line(at), ":") + 1, F.lit(MAX_LENGTH)))).otherwise("")
    return _let(F.array_position(lines["names"], F.lit(name)), value)


def header(head: Column, name: str) -> Column:
    """The first value of a field in an unfolded header block, empty without one."""
    return trimmed(F.regexp_extract(F.concat(F.lit("\n"), head), rf"(?i)\n[^\S\n]*{name}[^\S\n]*:([^\n]*)", 1))


def header_values(head: Column, name: str) -> Column:
    """All values of a field, in order."""
    lines = F.regexp_extract_all(F.concat(F.lit("\n"), head), F.lit(rf"(?i)\n[^\S\n]*{name}[^\S\n]*:([^\n]*)"), 1)
    return F.transform(lines, trimmed)


# --- parameters ---------------------------------------------------------------

#: Parameters that say something about a part.
WANTED = ("charset", "boundary", "name", "filename")


def _noted(done: Column, piece: Column) -> Column:
    """What is known after one more piece of a header value: the first is the value, the others are parameters."""
    text = F.struct(piece.alias("piece"), F.instr(piece, "=").alias("at"))
    pair = lambda x: F.struct(
        F.lower(trimmed(x["piece"])).alias("first"), (done["value"].isNotNull() & (x["at"] > 0)).alias("later"),
        F.regexp_replace(F.lower(trimmed(F.substring(x["piece"], F.lit(1), x["at"] - 1))), r"\*?\*\d*\z", "").alias("key"),
        F.regexp_replace(trimmed(F.substring(x["piece"], x["at"] + 1, F.length(x["piece"]))), r'(?s)\A"(.*)"\z', "$1").alias("value"),
    )
    known = lambda x: F.struct(F.coalesce(done["value"], x["first"]).alias("value"), *(F.when(x["later"] & (x["key"] == k), x["value"]).otherwise(done[k]).alias(k) for k in WANTED))
    return _let(_let(text, pair), known)


def parameters(value: Column) -> Column:
    """(value, charset, boundary, name, filename) of a header value; of repeated parameters the last counts.

    A fold over the value's tokens knows whether it is in quotes and how deep in angle brackets: semicolons there
    separate nothing.
    """
    none = F.lit(None).cast("string")
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("depth"), F.lit("").alias("piece"), F.struct(*(none.alias(k) for k in ("value", *WANTED))).alias("done"))

    def step(s: Column, t: Column) -> Column:
        free = ~s["quoted"]
        ends = free & (s["depth"] == 0) & (t == ";")
        return F.struct(
            F.when(t == '"', free).otherwise(s["quoted"]).alias("quoted"),
            F.when(free & (t == "<"), s["depth"] + 1).when(free & (t == ">"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]).alias("depth"),
            F.when(ends, "").otherwise(F.concat(s["piece"], t)).alias("piece"),
            F.when(ends, _noted(s["done"], s["piece"])).otherwise(s["done"]).alias("done"),
        )

    tokens = F.regexp_extract_all(value, F.lit(r'(?s)\\.|["<>;\\]|[^"<>;\\]+'), 0)
    return F.aggregate(tokens, start, step, lambda s: _noted(s["done"], s["piece"]))


# --- encoded words and addresses ----------------------------------------------


@F.arrow_udf(StringType())
def decode_words(values: pa.Array) -> pa.Array:
    """Encoded words of a header value as text; what can't be decoded stays, null is empty."""
    return pa.array(octets.words(values.to_pylist()), pa.string())


@F.arrow_udf(ArrayType(StringType()))
def decode_all(lists: pa.Array) -> pa.Array:
    """The same for each string of an array."""
    flat = lists.flatten()
    sizes = lists.value_lengths().fill_null(0)
    edges = [0, *sizes.to_numpy(zero_copy_only=False).cumsum().tolist()]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(octets.words(flat.to_pylist()), pa.string()))


@F.arrow_udf(ArrayType(StringType()))
def split_addresses(values: pa.Array) -> pa.Array:
    """Pieces between commas that aren't in quotes or angle brackets."""
    return octets.split_outside(values, ",")


def _person(raw: Column) -> Column:
    """raw, name (still encoded) and email of one trimmed piece of an address list."""

    def parted(x: Column) -> Column:
        # the brackets that end the piece, from the first "<" after the ">" before them
        at = F.when(x["raw"].endswith(">"), F.instr(x["tail"], "<")).otherwise(0)
        return F.struct(x["raw"].alias("raw"), x["inner"].alias("inner"), x["tail"].alias("tail"), at.alias("at"))

    def known(x: Column) -> Column:
        name = trimmed(F.substring(x["inner"], F.lit(1), F.length(x["inner"]) - F.length(x["tail"]) + x["at"] - 1))
        email = F.when(x["at"] > 0, trimmed(F.substring(x["tail"], x["at"] + 1, F.length(x["tail"])))).otherwise(x["raw"])
        return F.struct(
            x["raw"].alias("raw"), F.when(x["at"] > 0, F.regexp_replace(name, r'(?s)\A"(.*)"\z', "$1")).otherwise("").alias("name"),
            F.lower(trimmed(F.regexp_replace(email, r"(?i)\Amailto:", ""))).alias("email"),
        )

    inner = F.substring(raw, F.lit(1), F.length(raw) - 1)
    return _let(_let(F.struct(raw.alias("raw"), inner.alias("inner"), F.substring_index(inner, ">", -1).alias("tail")), parted), known)


def address_list(value: Column) -> Column:
    """Names, addresses and domains of a header value, as ``ADDRESS`` structs; pieces without @ keep a name only."""
    people = F.transform(F.filter(F.transform(split_addresses(value), trimmed), lambda p: p != ""), _person)
    names = decode_all(F.transform(people, lambda p: p["name"]))

    def one(z: Column) -> Column:
        p, name = z["person"], trimmed(F.regexp_replace(z["name"], r"(?s)\\(.)", "$1"))
        known = F.instr(p["email"], "@") > 0
        return F.struct(
            F.when(known | (name != ""), name).otherwise(p["raw"]).alias("name"), F.when(known, p["email"]).otherwise("").alias("email"),
            F.when(known, F.substring_index(p["email"], "@", -1)).otherwise("").alias("domain"), (known | (name != "") | (p["email"] != "")).alias("kept"),
        )

    both = F.arrays_zip(people.alias("person"), names.alias("name"))
    found = F.filter(F.transform(both, one), lambda p: p["kept"])
    return F.transform(F.slice(found, 1, MAX_ADDRESSES), lambda p: F.struct(p["name"].alias("name"), p["email"].alias("email"), p["domain"].alias("domain")))


# --- the tree of parts --------------------------------------------------------


def segments(body: Column, boundary: Column) -> Column:
    """What stands between lines of the boundary, up to the closing one; line ends count as one character."""
    mark = F.concat(F.lit(r"(?U)\n--\Q"), F.replace(boundary, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), F.when(boundary.rlike(r"[\s\x{FEFF}]\z"), r"(?!)").otherwise(""))  # blanks at a line's end don't count
    rest = F.lit(r"[\s\x{FEFF}&&[^\n]]*(?=\n|\z)")
    lines = F.struct(F.concat(F.lit("\n"), F.replace(body, F.lit("\r\n"), F.lit("\n"))).alias("text"), mark.alias("mark"))
    upto = lambda x: F.struct(F.get(F.split(x["text"], F.concat(x["mark"], F.lit("--"), rest), 2), F.lit(0)).alias("text"), x["mark"].alias("mark"))
    parts = _let(_let(lines, upto), lambda x: F.split(x["text"], F.concat(x["mark"], rest)))
    return F.filter(F.transform(parts, lambda p, i: F.when(i > 0, F.substring(p, 2, MAX_LENGTH))), lambda p: p.isNotNull())


def _opened(n: Column) -> Column:
    """A part's own parts, or the part itself with what is known of it; nothing for a multipart without boundary."""

    none = F.lit(None).cast("string")

    def told(p: Column) -> Column:
        ct, cd = p["ct"], p["cd"]
        filename = F.coalesce(F.nullif(cd["filename"], F.lit("")), F.nullif(ct["name"], F.lit("")))
        kind = ct["value"]
        return F.struct(
            p["body"].alias("body"), p["encoding"].alias("encoding"), ct["charset"].alias("charset"), ct["boundary"].alias("boundary"), kind.alias("type"), filename.alias("filename"),
            F.when((cd["value"] == "attachment") | (filename.isNotNull() & ~kind.startswith("text/")), "cargo").when(kind.startswith("multipart/"), "parts").when(kind == "text/html", "html").when(kind.startswith("text/") | (kind == ""), "text").otherwise("other").alias("kind"),
        )

    def nodes(t: Column) -> Column:
        leaf = F.struct(
            F.lit(True).alias("final"), F.when(t["kind"].isin("text", "html"), F.substring(t["body"], 1, MAX_BODY)).alias("source"), n["path"].alias("path"), n["marks"].alias("marks"), t["kind"].alias("kind"),
            t["encoding"].alias("encoding"), t["charset"].alias("charset"), F.coalesce(t["filename"], F.when(t["kind"] == "cargo", "(unnamed)").otherwise("(inline)")).alias("filename"),
            F.coalesce(F.nullif(t["type"], F.lit("")), F.lit("application/octet-stream")).alias("type"), F.length(t["body"]).cast("long").alias("size"),
        )
        marks = lambda i: F.when(t["type"] == "multipart/alternative", F.concat(n["marks"], F.array(F.struct(n["path"].alias("node"), i.alias("at"))))).otherwise(n["marks"])
        children = F.transform(
            F.slice(segments(t["body"], t["boundary"]), 1, MAX_PARTS),
            lambda s, i: F.struct(F.lit(False).alias("final"), s.alias("source"), F.concat(n["path"], F.lit("."), i.cast("string")).alias("path"), marks(i).alias("marks"), *(none.alias(c) for c in ("kind", "encoding", "charset", "filename", "type")), F.lit(None).cast("long").alias("size")),
        )
        return F.when(t["kind"] != "parts", F.array(leaf)).when(F.coalesce(t["boundary"], F.lit("")) != "", children).otherwise(F.array().cast(f"array<{_NODE}>"))

    def read(s: Column) -> Column:
        kind = F.coalesce(F.nullif(field(s["head"], "content-type"), F.lit("")), F.lit("text/plain"))
        return F.struct(parameters(kind).alias("ct"), parameters(field(s["head"], "content-disposition")).alias("cd"), field(s["head"], "content-transfer-encoding").alias("encoding"), s["body"].alias("body"))

    lines = lambda s: F.struct(named(s["head"]).alias("head"), s["body"].alias("body"))
    return _let(_let(head_and_body(n["source"]), lines), lambda s: _let(read(s), lambda p: _let(told(p), nodes)))


@F.arrow_udf(_FOUND)
def _folded(lists: pa.Array) -> pa.Array:
    """Text, HTML and attachments of each message's leaves, which come in order; all texts are decoded together.

    Within an alternative, what comes after the first part with text doesn't count.
    """
    flat = lists.flatten()
    fields = {k: flat.field(k).to_pylist() for k in ("kind", "encoding", "charset", "filename", "type", "size", "marks")}
    decoded = octets.bodies(flat.field("source"), fields["encoding"], octets.words(fields["charset"]))
    names = octets.words(fields["filename"])
    out, at = [], 0
    for size in lists.value_lengths().fill_null(0).to_pylist():
        text, html, files, first = "", "", [], {}
        for i in range(at, at + size):
            marks = fields["marks"][i] or []
            if any(first.get(m["node"], m["at"]) < m["at"] for m in marks):
                continue
            kind = fields["kind"][i]
            if kind == "text" and decoded[i]:
                text = text or decoded[i]
                for m in marks:
                    first.setdefault(m["node"], m["at"])
            elif kind == "html":
                html = html or decoded[i]
            elif kind in ("cargo", "other"):
                files.append({"filename": names[i], "contentType": fields["type"][i], "size": fields["size"][i]})
        at += size
        out.append({"text": text, "html": html, "attachments": files})
    kind = pa.struct([("text", pa.string()), ("html", pa.string()), ("attachments", pa.list_(pa.struct([("filename", pa.string()), ("contentType", pa.string()), ("size", pa.int64())])))])
    return pa.array(out, kind)


def with_leaves(rows: DataFrame, source: Column, name: str) -> DataFrame:
    """With an array of the parts of raw messages that have no parts, in order: level by level, every multipart is replaced by its parts.

    Parts below ``MAX_DEPTH`` levels, and those of a multipart beyond ``MAX_PARTS``, don't count.
    """
    none = F.lit(None).cast("string")
    root = F.struct(F.lit(False).alias("final"), F.coalesce(source, F.lit("")).alias("source"), F.lit("0").alias("path"), F.array().cast(f"array<{_MARK}>").alias("marks"), *(none.alias(c) for c in ("kind", "encoding", "charset", "filename", "type")), F.lit(None).cast("long").alias("size"))
    rows = rows.withColumn(name, F.array(root.cast(_NODE)))
    level = F.flatten(F.transform(name, lambda n: F.when(n["final"], F.array(n)).otherwise(_opened(n))))
    for _ in range(MAX_DEPTH + 1):
        rows = rows.withColumn(name, level)
    return rows.withColumn(name, F.filter(name, lambda n: n["final"]))


def with_structure(rows: DataFrame, source: Column, name: str) -> DataFrame:
    """With a column (text, html, attachments) of raw messages: the first plain text, the first HTML, and what else is named or unreadable."""
    rows = with_leaves(rows, source, "__leaves")
    # Python takes its input from a generated column: as an expression, lambdas within lambdas would hide it from the planner
    return rows.withColumn("__leaves", F.explode(F.array("__leaves"))).withColumn(name, _folded("__leaves")).drop("__leaves")
