"""Mail as columns, against versions written out character by character."""

import base64 as b64
import random
import re
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lettermill.functions import octets
from lettermill.functions.mime import address_list, decode_words, head_and_body, header, header_values, parameters, with_structure
from lettermill.sources.mail import normalize

SPACE = " \t\n\r\v\f\xa0﻿"


# --- by hand --------------------------------------------------------------------


def low(text):
    units = text.encode("utf-16-le", "surrogatepass")
    return bytes(units[::2])


def quoted_printable(text):
    data, out, i = text, bytearray(), 0
    while i < len(data):
        c, after = data[i], data[i + 1 : i + 3]
        if c != "=":
            out.append(ord(c) & 255)
            i += 1
        elif after == "" or after[0] == "\n" or after == "\r\n":
            i += 3 if after == "\r\n" else 2
        elif len(after) == 2 and all(x in "0123456789abcdefABCDEF" for x in after):
            out.append(int(after, 16))
            i += 3
        else:
            out.append(61)
            i += 1
    return bytes(out)


def base64(text):
    letters = [c for c in text.replace("-", "+").replace("_", "/") if re.match("[A-Za-z0-9+/]", c)]
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return b64.b64decode("".join(letters) + "=" * (-len(letters) % 4))


def cut(text, separator):
    out, piece, quoted, depth, escaped = [], "", False, 0, False
    for c in text:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "<":
            depth += 1
        elif not quoted and c == ">":
            depth = max(0, depth - 1)
        elif c == separator and not quoted and depth == 0:
            out.append(piece)
            piece = ""
            continue
        piece += c
    return [*out, piece]


def params(text):
    first, *rest = cut(text, ";")
    out = {"value": first.strip(SPACE).lower(), "charset": None, "boundary": None, "name": None, "filename": None}
    for piece in rest:
        key, eq, value = piece.partition("=")
        key, value = re.sub(r"\*$", "", re.sub(r"\*\d*$", "", key.strip(SPACE).lower())), value.strip(SPACE)
        if eq and key in out and key != "value":
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] == '"' else value
    return out


def words(text):
    text = re.sub(r"(\?=)[ \t]+(=\?)", r"\1\2", text)
    read = lambda m: octets.text(base64(m[3]) if m[2] in "Bb" else quoted_printable(m[3].replace("_", " ")), m[1])
    return re.sub(r"=\?([^?]+)\?([BbQq])\?([^?]*)\?=", read, text)


def people(text):
    out = []
    for piece in cut(text, ","):
        raw = piece.strip(SPACE)
        if not raw:
            continue
        m = re.match(r"(?s)(.*?)<([^>]*)>\s*\Z", raw)
        name, email = (m[1].strip(SPACE), m[2].strip(SPACE)) if m else ("", raw)
        name = name[1:-1] if len(name) > 1 and name[0] == name[-1] == '"' else name
        name = re.sub(r"(?s)\\(.)", r"\1", words(name)).strip(SPACE)
        email = re.sub("(?i)^mailto:", "", email).strip(SPACE).lower()
        if "@" in email:
            out.append((name, email, email.rpartition("@")[2]))
        elif name or email:
            out.append((name or raw, "", ""))
    return out[:256]


def field(head, name):
    for line in re.split(r"\r?\n", re.sub(r"\r?\n[ \t]+", " ", head[: 256 << 10])):
        key, colon, value = line.partition(":")
        if colon and key and key.strip(SPACE).lower() == name:
            return value.strip(SPACE)
    return ""


def parts(body, boundary):
    out, now = [], None
    for line in re.split(r"\r?\n", body):
        end = line.rstrip(SPACE)
        if end == f"--{boundary}":
            if now is not None:
                out.append("\n".join(now))
            now = []
        elif end == f"--{boundary}--":
            if now is not None:
                out.append("\n".join(now))
            return out
        elif now is not None:
            now.append(line)
    return [*out, "\n".join(now)] if now else out


def tree(source, depth=0):
    if depth > 8:
        return "", "", []
    at = re.search(r"\r?\n\r?\n", source)
    head, body = (source[: at.start()], source[at.end() :]) if at else (source, "")
    ct, cd = params(field(head, "content-type") or "text/plain"), params(field(head, "content-disposition"))
    name, kind = cd["filename"] or ct["name"], ct["value"]
    if cd["value"] == "attachment" or name and not kind.startswith("text/"):
        return "", "", [(words(name or "(unnamed)"), kind or "application/octet-stream", len(body))]
    if kind.startswith("multipart/"):
        text, html, files = "", "", []
        for p in parts(body, ct["boundary"])[:64] if ct["boundary"] else []:
            t, h, f = tree(p, depth + 1)
            text, html, files = text or t, html or h, files + f
            if kind == "multipart/alternative" and text:
                break
        return text, html, files
    how, body2 = field(head, "content-transfer-encoding").lower(), body[: 2 << 20]
    data = base64(re.sub(r"\s", "", body2)) if how == "base64" else quoted_printable(body2.replace("\r\n", "\n")) if how == "quoted-printable" else low(body2)
    if kind == "text/html":
        return "", octets.text(data, ct["charset"]), []
    if kind.startswith("text/") or not kind:
        return octets.text(data, ct["charset"]), "", []
    return "", "", [("(inline)", kind, len(body))]


# --- rows at once ---------------------------------------------------------------

BROKEN = st.lists(st.text(alphabet="=AFaf09\r\n_-+/ é€😀g", max_size=24), max_size=8)


def rows(data, offsets):
    return [data.tobytes()[i:j] for i, j in zip(offsets.tolist(), offsets.tolist()[1:])]


@given(BROKEN)
@settings(max_examples=400, deadline=None)
def test_decoders_equal_single_steps(values):
    raw = octets.octets(pa.array(values, pa.string()))
    assert rows(*raw) == [low(v) for v in values]
    assert rows(*octets.quoted_printable(*raw)) == [quoted_printable(low(v).decode("latin-1")) for v in values]
    assert rows(*octets.base64(*raw)) == [base64(low(v).decode("latin-1")) for v in values]
    assert rows(*octets.without_returns(*raw)) == [low(v).replace(b"\r\n", b"\n") for v in values]


@given(st.lists(st.text(alphabet='ab,;<>"\\é 😀', max_size=24), max_size=8), st.sampled_from(",;"))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_single_steps(values, separator):
    assert octets.split_outside(pa.array(values, pa.string()), separator).to_pylist() == [cut(v, separator) for v in values]


@given(st.lists(st.lists(st.sampled_from(["=?utf-8?Q?a=C3=A9_b?=", "=?UTF-8?b?w6k=?=", " ", "\t", "x", "=?iso-8859-1?q?=E9?=", "=?nonsense?Q?=E9?=", "=?", "?=", "=?utf-8?X?y?=", "=?big5?B?pKQ?="]), max_size=6).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoded_words_equal_single_steps(values):
    assert octets.words(values) == [words(v) for v in values]


def test_character_sets():
    read = octets.text
    assert read(b"\x80\x81\xe9", "iso-8859-1") == read(b"\x80\x81\xe9", "US-ASCII") == "€\x81é" and read(b"\xef\xbb\xbfx\xff", "utf-8") == "x�"
    assert read(b"\x80", '"Windows-1252"') == "€" and read(b"\x80\xe9", "no-such") == "\x80é" and read(b"a\0", "utf-16") == "a" and read(b"x", None) == "x"
    assert read(b"+AGE-", "utf-7") == "+AGE-" and read(b"rot", "rot13") == "rot" and read(b"\x82\xa0", "shift_jis") == "あ" and read(b"z", "\0") == "z"


def test_empty_inputs():
    none = pa.array([], pa.string())
    assert octets.words([]) == [] and octets.split_outside(none, ",").to_pylist() == [] and octets.bodies(none, [], []) == []
    assert octets.split_outside(pa.array([None, ""]), ",").to_pylist() == [[""], [""]] and octets.words([None]) == [""]


# --- columns --------------------------------------------------------------------

HOSTILE = ["", "x", ";", ";;a=b", 'text/plain; charset="utf-8"', 'multipart/mixed; boundary="a;b"; charset=utf-8', "a; name*0=x; name*=y; NAME = z ", "a;b=<;c=d>;charset=e", 'a; boundary="q\\";r"; charset', "<<a>;charset=x", "a>;charset=<x>;name=y", "t; =x; charset==; name=\"", "\\;x;charset=\\\\"]


def test_parameters(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(HOSTILE)], "i int, v string").select("i", parameters(F.col("v")).alias("p")).collect()
    for r in got:
        assert r.p.asDict() == params(HOSTILE[r.i]), HOSTILE[r.i]


def test_header_fields(spark):
    raw = "Subject: a long\r\n  one\r\nReceived: 1\r\nRECEIVED : 2\r\nX\r\n:no\r\nTo:\r\nsubject: later\r\n\r\nSubject: body"
    row = spark.createDataFrame([(raw,)], "r string").select(head_and_body(F.col("r")).alias("h")).select(header(F.col("h.head"), "subject").alias("s"), header_values(F.col("h.head"), "received").alias("v"), header(F.col("h.head"), "to").alias("t"), header(F.col("h.head"), "cc").alias("c"), "h.body").first()
    assert (row.s, row.v, row.t, row.c, row.body) == ("a long one", ["1", "2"], "", "", "Subject: body")
    long = "A: " + "x" * (256 << 10) + "\r\nSubject: too late\r\n\r\n"
    assert spark.createDataFrame([(long,)], "r string").select(header(head_and_body(F.col("r"))["head"], "subject")).first()[0] == ""


LISTS = [
    '"Whitfield, Dana" <dana@x.example>, bob@y.example', "", None, ",, ,", "Team:;", "undisclosed-recipients:;, a@b", "broken@@no-really", "x <y> <z@w> ", "<mailto:A@B.C>", '"q\\"uote, d" <e@f>', "=?utf-8?B?w6k=?= <g@h>, =?utf-8?Q?a?=  =?utf-8?Q?b?= <i@j>",
    "a <b@c", "c> d <e@f>", "<>", '"" <k@l>', "\\, x@y", ", ".join(f"p{i}@q" for i in range(300)), '"open, r@s',
]


def test_address_lists(spark):
    got = spark.createDataFrame([(i, v) for i, v in enumerate(LISTS)], "i int, v string").select("i", address_list(F.col("v")).alias("p")).collect()
    for r in got:
        assert [tuple(p) for p in r.p] == people(LISTS[r.i] or ""), LISTS[r.i]


def made(rnd, depth=0):
    """A message of nested, encoded and broken parts."""
    eol = rnd.choice(["\r\n", "\n"])
    kind = rnd.choice(["multipart/mixed", "multipart/alternative", "text/plain", "text/html", "text/plain", "application/pdf", "", "multipart/related"]) if depth < 4 else rnd.choice(["text/plain", "text/html", "image/png"])
    lines = [f"Content-Type: {kind}"] if kind else []
    body = rnd.choice(["hello =3D caf=C3=A9=" + eol + "on", "aGVsbG8g\r\nd29ybGQ", "", " ", "plain é text", "<p>x</p>", "--b0", "a" + eol + eol + "b"])
    if kind.startswith("multipart/"):
        boundary = rnd.choice([f"b{depth}", "b;0", "x\\E.*", "b0", f"b{depth} "])
        mark = boundary.strip()
        lines[0] += rnd.choice([f'; boundary="{boundary}"', f"; boundary={mark}", "", f'; BOUNDARY="{mark}"; charset=utf-8'])
        inner = [made(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
        body = "preamble" + eol + "".join(f"--{mark}{rnd.choice(['', ' ', chr(9)])}{eol}{p}{eol}" for p in inner) + rnd.choice([f"--{mark}--", "", f"--{mark}", f"--{mark}--{eol}--{mark}{eol}late"])
    elif rnd.random() < 0.6:
        lines.append("Content-Transfer-Encoding: " + rnd.choice(["base64", "Quoted-Printable", "8bit", "odd"]))
    if rnd.random() < 0.2:
        lines.append("Content-Disposition: " + rnd.choice(["attachment", 'attachment; filename="=?utf-8?Q?f=C3=A9?=.x"', "inline; filename=g.txt", "inline"]))
    rnd.shuffle(lines)
    return eol.join(lines) + eol + eol + body


def test_trees_equal_recursion(spark):
    rnd = random.Random(7)
    raw = [made(rnd) for _ in range(400)] + ["", "no header", "\n\nbody", "Content-Type: multipart/mixed; boundary=q\n\n" + "".join(f"--q\nContent-Disposition: attachment; filename=f{i}\n\nx\n" for i in range(70))]
    got = spark.createDataFrame(list(enumerate(raw)), "i int, r string").transform(with_structure, F.col("r"), "s").collect()
    assert len(got) == len(raw)
    for r in got:
        assert (r.s.text, r.s.html, [tuple(a) for a in r.s.attachments]) == tree(raw[r.i]), raw[r.i]
    assert sum(bool(r.s.text) for r in got) > 100 and sum(len(r.s.attachments) for r in got) > 100


def test_nested_parts_are_bounded(spark):
    bomb = "Content-Type: text/plain\r\n\r\ninner"
    for i in range(40):
        bomb = f'Content-Type: multipart/mixed; boundary="B{i}"\r\n\r\n--B{i}\r\n{bomb}\r\n--B{i}--'
    one = spark.createDataFrame([(bomb,)], "r string").transform(with_structure, F.col("r"), "s")
    one.collect()
    began = time.time()
    assert one.first().s.text == ""
    assert time.time() - began < 2


def test_a_wide_message(spark):
    """Ten thousand small parts, alternatives within alternatives."""
    inner = "".join(f"--i\n\nt{k}\n" for k in range(60))
    middle = "".join(f"--m\nContent-Type: multipart/alternative; boundary=i\n\n{inner}" for _ in range(60))
    raw = "Content-Type: multipart/alternative; boundary=o\n\n" + "".join(f"--o\nContent-Type: multipart/mixed; boundary=m\n\n{middle}" for _ in range(4))
    assert spark.createDataFrame([(raw,)], "r string").transform(with_structure, F.col("r"), "s").first().s.text == tree(raw)[0]


def test_messages_of_latin_bytes(spark):
    """What a session read as bytes is decoded by the character set that the message names."""
    raw = "From: =?utf-8?B?Sm9zw6k=?= <Jose@Example.es>\r\nSubject: =?utf-8?Q?Hello?= =?utf-8?Q?World?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\n" + "café €".encode().decode("latin-1")
    base = {"flags": F.lit(None).cast("array<string>"), "internalDate": F.lit(None).cast("timestamp"), "size": F.lit(0)}
    row = normalize(spark.createDataFrame([(1, raw)], "uid long, raw string").withColumns(base)).first()
    assert (row["from"].name, row["from"].email, row.subject, row.bodyText) == ("José", "jose@example.es", "HelloWorld", "café €")


@pytest.mark.parametrize("value, want", [(None, ""), ("=?utf-8?Q?Hello?= =?utf-8?Q?World?=", "HelloWorld"), ("=?x", "=?x")])
def test_words_of_a_column(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(decode_words("v")).first()[0] == want
