"""Text columns: folding, HTML, ids, addresses, previews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks of every script: the characters that SQL's trim takes off.
BLANKS = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

#: White space of every script, for trimming.
SPACE = "\t\n\v\f\r\u2028\u2029\ufeff" + BLANKS


def trimmed(text: Column) -> Column:
    """Without white space at the ends; only the ends are looked at."""
    return F.btrim(text, F.lit(SPACE))


def unfold(text: Column) -> Column:
    """Header lines that go on in the next line."""
    for blank in ("\t", " "):
        text = F.replace(text, F.lit("\r\n" + blank), F.lit("\n" + blank))
    return F.regexp_replace(text, r"\n[ \t]+", " ")


def collapse(text: Column, ends: str = SPACE) -> Column:
    """No carriage returns, at most one empty line, single blanks, trimmed of the characters in ``ends``."""
    text = F.replace(text, F.lit("\r"), F.lit(""))
    for pattern, by in ((r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        text = F.regexp_replace(text, pattern, by)
    return F.btrim(text, F.lit(ends))


#: Patterns of markup and what stands for them, in this order.
_HTML = (
    (r"(?is)<(script|style).*?</\1>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</(p|div|tr|h[1-6]|li)>", "\n"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"<[^>]+>", " "),
    ("(?i)&nbsp;", " "),
    ("(?i)&amp;", "&"),
    ("(?i)&lt;", "<"),
    ("(?i)&gt;", ">"),
    ("(?i)&quot;", '"'),
)


def _numbered(text: Column) -> Column:
    """Decimal character references; outside of Unicode they become nothing."""
    ends = F.split(text, "&#")
    code = lambda p: F.try_to_number(F.substring_index(p, ";", 1), F.lit("9999999"))
    wide = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("int")), 8, "0")), "UTF-32")
    first = F.get(ends, F.lit(0))
    rest = F.transform(
        F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(1))),
        lambda p: F.when(p.rlike(r"\A\d{1,7};"), F.concat(F.when((code(p) > 0) & (code(p) < 0x110000), wide(code(p))).otherwise(""), F.expr("''"), F.substring(p, F.instr(p, ";") + 1, F.length(p)))).otherwise(F.concat(F.lit("&#"), p)),
    )
    return F.when(F.instr(text, "&#") > 0, F.concat(first, F.array_join(rest, ""))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text of a mail body in HTML."""
    for pattern, by in _HTML:
        html = F.regexp_replace(html, pattern, by)
    html = _numbered(html)
    html = F.regexp_replace(F.regexp_replace(html, r"[ \t]+", " "), r"\n\s*\n\s*\n+", "\n\n")
    return trimmed(html)


def best_text(text: Column, html: Column) -> Column:
    """Plain text if there is any, else what the HTML shows."""
    plain = trimmed(F.coalesce(text, F.lit("")))
    return F.when(plain != "", plain).otherwise(html_to_text(F.coalesce(html, F.lit(""))))


def message_id(header: Column) -> Column:
    return F.regexp_extract(header, "<[^>]+>", 0)


def thread_key(references: Column, in_reply_to: Column, own_id: Column) -> Column:
    """The thread's root: the first id that is referred to, else the message's own."""
    first = lambda c: F.nullif(message_id(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(first(references), first(in_reply_to), own_id)


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def display_from(sender: Column) -> Column:
    return F.when(sender["name"] != "", F.concat(sender["name"], F.lit(" <"), sender["email"], F.lit(">"))).otherwise(sender["email"])


def shortened(text: Column, n: int) -> Column:
    """At most n characters, an ellipsis for what is cut off."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def word_count(text: Column) -> Column:
    """Pieces between white space, empty ones at the edges included."""
    return F.size(F.split(text, r"\s+"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def text_blocks(blocks: Column) -> Column:
    """The texts of an answer's blocks (type, text) of type text, put together; empty without any."""
    texts = F.filter(blocks, lambda b: b["type"] == "text")
    return F.coalesce(trimmed(F.array_join(F.transform(texts, lambda b: F.coalesce(b["text"], F.lit(""))), "")), F.lit(""))


def safe_json(text: Column, schema: str) -> Column:
    """The text as JSON, else its outermost braces as JSON, else null."""
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    parsed = lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    return F.coalesce(parsed(text), parsed(braces))
