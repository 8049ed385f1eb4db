"""Queries over mail as it is sent: the given texts in transfer encodings, header fields, parameters and address lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.functions.mime import address_list, decode_words, head_and_body, header, parameters
from lettermill.plans.registry import query, spread, table
from lettermill.sources.mail import normalize
from lettermill.sources.shared import small_batches

#: Four shapes of a message around the whole text; what is encoded differs, the text doesn't.
_RAW = """
concat('From: =?utf-8?Q?', translate(source, ' ', '_'), '?= <', source, '@', lang, '.Example>', char(13), char(10),
 'Subject: =?utf-8?B?', b64s, '?=', char(13), char(10), ' =?utf-8?Q?', regexp_replace(hex(encode(lang, 'UTF-8')), '(..)', '=$1'), '?=', char(13), char(10),
 case doc_id % 4
  when 0 then concat('Content-Type: text/plain; charset=utf-8\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n', b64)
  when 1 then concat('Content-Type: text/plain; charset="UTF-8"\\r\\nContent-Transfer-Encoding: Quoted-Printable\\r\\n\\r\\n', qp)
  when 2 then concat('Content-Type: multipart/alternative; boundary="q;', lang, '"\\r\\n\\r\\npreamble\\r\\n--q;', lang, '\\r\\nContent-Transfer-Encoding: base64\\r\\n\\r\\n', b64, '\\r\\n--q;', lang, '\\r\\nContent-Type: application/pdf; name=late.pdf\\r\\n\\r\\nx\\r\\n--q;', lang, '--\\r\\n')
  else concat('Content-Type: multipart/mixed; boundary=outer\\r\\n\\r\\n--outer\\r\\nContent-Type: multipart/related; boundary=inner\\r\\n\\r\\n--inner\\r\\nContent-Type: text/html\\r\\n\\r\\n<p>markup</p>\\r\\n--inner\\r\\nContent-Type: text/plain; charset=utf-8\\r\\nContent-Transfer-Encoding: quoted-printable\\r\\n\\r\\n', qp,
   '\\r\\n--inner--\\r\\n--outer \\r\\nContent-Disposition: attachment; filename="=?utf-8?Q?', regexp_replace(hex(encode(source, 'UTF-8')), '(..)', '=$1'), '?=.bin"\\r\\n\\r\\n', source, '\\r\\n--outer--') end)"""


@query("""
SELECT doc_id AS uid, source AS from_name, concat(lower(source), '@', lower(lang), '.example') AS from_email, sha256(concat('S ', text, ' E', lang)) AS subject_sha256, sha256(concat('A ', text, ' Z')) AS body_sha256,
 CAST(length(text) + 4 AS BIGINT) AS body_chars, CASE WHEN doc_id % 4 = 3 THEN concat(source, '.bin|text/plain|', length(source)) END AS files FROM documents""")
def mime_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as the bodies and subjects of raw messages in base64 and quoted-printable, alone and within parts, read back."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "lang", "replace(base64(encode(concat('A ', text, ' Z'), 'UTF-8')), '\\r\\n', '') AS b64", "replace(base64(encode(concat('S ', text, ' E'), 'UTF-8')), '\\r\\n', '') AS b64s",
        "if(doc_id % 2 = 1, regexp_replace(hex(encode(concat('A ', text, ' Z'), 'UTF-8')), '..', '=$0'), null) AS qp",
    )
    rows = docs.select(F.col("doc_id").alias("uid"), F.expr(_RAW).alias("raw"), F.array().cast("array<string>").alias("flags"), F.lit(None).cast("timestamp").alias("internalDate"), F.lit(0).alias("size"))
    files = F.transform("attachments", lambda a: F.concat_ws("|", a["filename"], a["contentType"], a["size"].cast("string")))
    return normalize(rows).select("uid", F.col("from.name").alias("from_name"), F.col("from.email").alias("from_email"), F.sha2("subject", 256).alias("subject_sha256"), F.sha2("bodyText", 256).alias("body_sha256"), F.char_length("bodyText").cast("long").alias("body_chars"), F.nullif(F.array_join(files, ","), F.lit("")).alias("files"))


@query("""
WITH p AS (SELECT c_custkey, [
 {'pos': 0, 'name': concat(c_name, ', ', c_mktsegment), 'email': concat('c', c_custkey, '@', lower(c_mktsegment), '.example'), 'domain': concat(lower(c_mktsegment), '.example')},
 {'pos': 1, 'name': '', 'email': concat('n', c_nationkey, '@n.example'), 'domain': 'n.example'},
 {'pos': 2, 'name': concat('Team ', c_nationkey, ':;'), 'email': '', 'domain': ''},
 {'pos': 3, 'name': concat('é "', c_nationkey, '"'), 'email': concat('x', c_custkey, '@a@b.example'), 'domain': 'b.example'}] AS people FROM customer)
SELECT c_custkey, u.pos AS pos, u.name AS name, u.email AS email, u.domain AS domain FROM (SELECT c_custkey, unnest(people) AS u FROM p)""")
def address_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, addresses and domains of address lists made of customers: commas in quotes, groups, escapes, encoded words, odd addresses."""
    value = F.expr("""concat('"', c_name, ', ', c_mktsegment, '" <C', c_custkey, '@', c_mktsegment, '.Example>, , mailto:N', c_nationkey, '@n.example , Team ', c_nationkey, ':;,"=?utf-8?Q?=C3=A9?= \\\\"', c_nationkey, '\\\\"" <X', c_custkey, '@a@B.example >')""")
    people = spread(table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", address_list(value).alias("people"))
    return people.select("c_custkey", F.posexplode("people").alias("pos", "p")).select("c_custkey", "pos", "p.name", "p.email", "p.domain")


@query("""
SELECT p_partkey, lower(p_type) AS value, p_brand AS charset, concat(p_brand, ';', p_size) AS boundary, concat(p_name, ' <', p_size, ';>') AS name, CASE WHEN p_size % 2 = 0 THEN p_name END AS filename FROM part""")
def header_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and parameters of header values made of parts: separators in quotes and brackets, continued and repeated names."""
    value = F.expr("""concat(p_type, '; CHARSET="', p_brand, '";; name=first; name*0=', p_name, ' <', p_size, ';>; boundary="', p_brand, ';', p_size, '"', if(p_size % 2 = 0, concat(';filename* = "', p_name, '"'), ';filename'))""")
    return table(spark, sf_dir, "part").select("p_partkey", parameters(value).alias("p")).select("p_partkey", *(F.col(f"p.{k}").alias(k) for k in ("value", "charset", "boundary", "name", "filename")))


@query("""
SELECT doc_id, sha256(regexp_replace(concat('A ', text, ' Z'), '\\n[ \\t]*', ' ', 'g')) AS folded_sha256, lang AS first, CAST(length(concat('A ', text, ' Z')) AS BIGINT) AS body_chars, sha256(concat('A ', text, ' Z')) AS words_sha256 FROM documents""")
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as folded header fields and as encoded words, and what follows the header block."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.lit("A "), "text", F.lit(" Z")).alias("t"))
    raw = F.concat(F.lit("X-Lang: "), "lang", F.lit("\r\nX-Text :  "), F.replace("t", F.lit("\n"), F.lit("\r\n\t")), F.lit("\r\nx-lang: other\r\n\r\n"), "t")
    parts = docs.select("doc_id", head_and_body(raw).alias("h"), decode_words(F.concat(F.lit("=?UTF-8?b?"), F.regexp_replace(F.base64(F.encode("t", "UTF-8")), "\r\n", ""), F.lit("?="))).alias("w"))
    return parts.select("doc_id", F.sha2(header(F.col("h.head"), "x-text"), 256).alias("folded_sha256"), header(F.col("h.head"), "x-lang").alias("first"), F.char_length("h.body").cast("long").alias("body_chars"), F.sha2("w", 256).alias("words_sha256"))
