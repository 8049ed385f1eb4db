"""Queries: folders and scans, lookups, replies, cost notes, dates and numbers, marks of senders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lettermill.functions.numbers import clamp01, header_date, imap_date, iso, money, percent
from lettermill.functions.text import safe_json, text_blocks
from lettermill.operators import mailbox as M
from lettermill.operators import voice as V
from lettermill.operators.cascade import classify
from lettermill.operators.correspondents import with_rules
from lettermill.plans.adapters import MAIL_SQL, OWN, messages
from lettermill.plans.records import _TURN, _turns
from lettermill.plans.registry import query, table
from lettermill.plans.triage import _SCORES, _WHY, _as_of, _with_people, decisions

_NONE = "array<struct<name: string, email: string, domain: string>>"


def _boxes(spark):
    own = spark.createDataFrame([("later", "Someday"), ("brief", "")], "kind string, name string")
    told = spark.createDataFrame([("sent", "Sent Items"), ("later", "never")], "kind string, name string")
    return M.resolve_folders(own, told)


@query("""SELECT * FROM (VALUES ('inbox', 'INBOX'), ('drafts', NULL), ('brief', 'Brief'), ('noise', 'Noise')) t(kind, name)
 UNION ALL SELECT 'sent', min_by(n_name, n_nationkey) FROM nation WHERE n_nationkey % 7 = 3 UNION ALL SELECT 'later', min_by(r_name, r_regionkey) FROM region WHERE r_regionkey > 1""")
def resolved_folders(spark, sf_dir):
    """Folders for each kind: one's own settings (of regions) before what the server says (of nations), before the defaults."""
    own = table(spark, sf_dir, "region").where("r_regionkey > 1").agg(F.lit("later").alias("kind"), F.min_by("r_name", "r_regionkey").alias("name")).select("kind", "name")
    told = table(spark, sf_dir, "nation").where("n_nationkey % 7 = 3").agg(F.lit("sent").alias("kind"), F.min_by("n_name", "n_nationkey").alias("name")).select("kind", "name")
    return M.resolve_folders(own.unionByName(spark.createDataFrame([("brief", "")], "kind string, name string")), told.unionByName(told.select(F.lit("later").alias("kind"), "name")))


def _sorted_mail(spark, sf_dir):
    place = F.when(F.col("uid") % 4 == 0, "Sent Items").when(F.col("uid") % 4 == 1, "Sent").otherwise("INBOX")
    return messages(spark, sf_dir).withColumns({"folder": place, "replyTo": F.when(F.col("uid") % 3 == 0, F.array("from")).otherwise(F.array().cast(_NONE))})


@query(f"""WITH {MAIL_SQL}, b AS (SELECT uid, CASE uid % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'other' ELSE 'inbox' END AS kind FROM mail WHERE minutes >= 1440),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY uid DESC) AS k FROM b) SELECT uid, kind FROM r WHERE k <= 150 AND kind <> 'other'""")
def folder_scans(spark, sf_dir):
    m, boxes = _sorted_mail(spark, sf_dir), _boxes(spark)
    one = lambda kind: M.scan(m, boxes, kind, F.timestamp_seconds(F.lit(1_704_067_200 + 2 * 86_400)), 1, 150).select("uid", F.lit(kind).alias("kind"))
    return one("inbox").unionByName(one("sent")).unionByName(one("drafts"))


@query(f"WITH {MAIL_SQL} SELECT uid, md5(body) AS digest FROM mail WHERE uid IN (SELECT doc_id FROM labels WHERE quality = 0)")
def bodies_by_uid(spark, sf_dir):
    wanted = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("uid"))
    return M.with_uids(messages(spark, sf_dir), wanted).select("uid", F.md5("bodyText").alias("digest"))


@query(f"WITH {MAIL_SQL} SELECT uid, subject FROM mail WHERE uid = 18 UNION ALL SELECT count(*), 'own' FROM mail WHERE uid % 4 < 2")
def cached_lookups(spark, sf_dir):
    m = _sorted_mail(spark, sf_dir)
    found = M.cached_message(m, 18).unionByName(M.cached_message(m, 17)).select("uid", "subject")
    return found.unionByName(M.own_messages(m).agg(F.count("*").alias("uid")).withColumn("subject", F.lit("own")))


@query(f"""WITH {MAIL_SQL} SELECT uid, md5(concat('From: {OWN[0]}', chr(10), 'To: ', email, chr(10), 'Subject: ', CASE WHEN starts_with(lower(subject), 're:') THEN subject ELSE concat('Re: ', subject) END, chr(10),
 'In-Reply-To: <', uid, '@x>', chr(10), 'References: <', uid, '@x>', chr(10), 'Content-Type: text/plain; charset=utf-8', chr(10), chr(10), 'Will do: ', body)) AS digest FROM mail""")
def reply_texts(spark, sf_dir):
    return _sorted_mail(spark, sf_dir).select("uid", F.md5(M.reply(OWN[0], F.concat(F.lit("Will do: "), "bodyText"))).alias("digest"))


@query(f"""WITH {_WHY} SELECT uid, CAST(to_json({{'uid': uid, 'messageId': concat('<', uid, '@x>'), 'label': label, 'confidence': confidence, 'tier': 0, 'reasons': [{{'code': x.code, 'detail': x.detail}} FOR x IN reasons]}}) AS VARCHAR) AS json FROM why""")
def decisions_as_json(spark, sf_dir):
    return M.decisions_json(decisions(spark, sf_dir))


@query("SELECT round(sum(value), 4) AS usd, sum(user_id)::BIGINT AS input, sum(event_id)::BIGINT AS output, count(*) AS calls, count(*) AS runs FROM events WHERE event_type = 'error' AND user_id % 2 = 0")
def cost_note_totals(spark, sf_dir):
    notes = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "note").otherwise("result").alias("phase"), F.when(F.col("user_id") % 2 == 0, "cost").otherwise("undone").alias("type"), F.col("value").alias("usd"), F.col("user_id").alias("input"), F.col("event_id").alias("output"), F.lit(1).alias("calls"))
    return M.cost_notes(notes).withColumn("usd", F.round("usd", 4))


@query("SELECT event_id, event_type AS action, CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('m', user_id) END AS \"messageId\", CASE WHEN user_id % 2 = 0 THEN '' ELSE 'Later' END AS \"to\", CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS INT) AS flags FROM events")
def normalized_actions(spark, sf_dir):
    i, text = F.col("user_id"), F.lit(None).cast("string")
    raw = F.struct(F.col("event_type").alias("action"), F.col("event_id").alias("uid"), F.when(i % 3 > 0, F.concat(F.lit("m"), i.cast("string"))).alias("messageId"), text.alias("from"), F.when(i % 2 == 1, "Later").alias("to"), F.when(i % 5 > 0, F.array(F.lit("\\Seen"))).alias("flags"), text.alias("label"))
    a = table(spark, sf_dir, "events").select("event_id", M.normalized(raw).alias("a"))
    return a.select("event_id", "a.action", "a.messageId", "a.to", F.size("a.flags").alias("flags"))


@query("""WITH o AS (SELECT o_orderkey, make_timestamp((1704067200 + o_orderkey * 61) * 1000000) AS t FROM orders)
 SELECT o_orderkey, strftime(t, '%d-%b-%Y') AS day, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE concat(strftime(t - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S'), '.000Z') END AS parsed,
 concat(strftime(t, '%Y-%m-%dT%H-%M-%S'), '-000Z-', left(md5(CAST(o_orderkey AS VARCHAR)), 6)) AS run FROM o""")
def dates_and_runs(spark, sf_dir):
    t, k = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("o_orderkey") * 61), F.col("o_orderkey") % 4
    plain = F.date_format(t, "d MMM yyyy HH:mm:ss")
    header = F.when(k == 0, F.concat(F.lit("Mon, "), plain, F.lit(" +0200"))).when(k == 1, F.concat(plain, F.lit(" +0200 (CEST)"))).when(k == 2, F.concat(plain, F.lit(" +0200"))).otherwise("some day")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", imap_date(t).alias("day"), iso(header_date(header)).alias("parsed"), M.run_id(t, F.col("o_orderkey")).alias("run"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE (o_custkey % 100) / 128.0 END::DOUBLE AS confidence,
 CASE WHEN o_orderkey % 9 = 0 OR o_custkey = 0 THEN '$0.00' WHEN o_custkey / 7919.0 < 0.01 THEN printf('$%.4f', o_custkey / 7919.0) ELSE printf('$%.2f', o_custkey / 7919.0) END AS usd, concat(CAST(floor(o_custkey / 7919.0 * 100 + 0.5) AS BIGINT), '%') AS share FROM orders""")
def confidence_and_money(spark, sf_dir):
    k, x = F.col("o_orderkey") % 5, F.col("o_custkey") / 7919.0
    said = F.when(k == 0, "high").when(k == 1, "7").when(k == 2, "-0.5").otherwise(((F.col("o_custkey") % 100) / 128.0).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", clamp01(said).alias("confidence"), money(F.when(F.col("o_orderkey") % 9 == 0, 0.0).otherwise(x)).alias("usd"), percent(x).alias("share"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN source END AS label, CASE WHEN doc_id % 4 < 2 THEN doc_id END AS n, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(source, lang) END AS said FROM documents")
def tolerant_answers(spark, sf_dir):
    k = F.col("doc_id") % 4
    plain = F.concat(F.lit('{"label":"'), "source", F.lit('","n":'), F.col("doc_id").cast("string"), F.lit("}"))
    text = F.when(k == 0, plain).when(k == 1, F.concat(F.lit("Here:\n```json\n"), plain, F.lit("\n``` done"))).when(k == 2, F.lit('{"label":')).otherwise("none")
    block = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    blocks = F.when(k > 0, F.array(block("text", F.concat(F.lit(" "), "source")), block("thinking", F.lit("?")), block("text", F.concat("lang", F.lit(" ")))))
    return table(spark, sf_dir, "documents").select("doc_id", safe_json(text, "label string, n bigint").alias("a"), text_blocks(blocks).alias("said")).select("doc_id", "a.label", "a.n", "said")


@query(f"""WITH s AS (SELECT {_TURN} AS body, conv_id * 1000 + turn AS seq FROM conversations WHERE role = 'user'), l AS (SELECT seq, [x FOR x IN string_split(body, chr(10)) IF trim(x) <> ''][1:4] AS ls FROM s WHERE length(body) > 20 ORDER BY seq DESC LIMIT 3)
 SELECT seq, concat('> ', array_to_string(ls, concat(chr(10), '> '))) AS example FROM l""")
def voice_examples(spark, sf_dir):
    return V.examples(V.sample(_turns(spark, sf_dir)))


@query(f"""WITH {_SCORES} SELECT uid, CASE WHEN email LIKE 'src1@en%' THEN 'vip' WHEN email LIKE 'src2@%' THEN 'muted' WHEN uid % 12 IN (1, 5) THEN 'auto-submitted' WHEN uid % 10 IN (1, 3, 4) THEN 'bulk'
 WHEN failed AND (sent_to > 0 OR received_from > 2) THEN 'impersonation' WHEN uid % 7 = 6 THEN 'thread-participant' WHEN sent_to >= 3 AND NOT failed AND (43200 - last_sent) / 1440.0 <= 180 THEN 'known-correspondent'
 WHEN sent_to = 0 AND received_from >= 5 THEN 'never-answered' ELSE 'weighted' END AS rule FROM s""")
def marks_and_headers(spark, sf_dir):
    """Important and muted senders, own threads, and what headers say in odd cases and spellings."""
    i = F.col("uid")
    auto = F.when((i % 12).isin(1, 5), "auto-generated").when(i % 2 == 0, " No ").otherwise("")
    said = F.when(i % 10 == 1, " Bulk").when(i % 10 == 3, "list").when(i % 10 == 4, "JUNK ").when(i % 10 == 5, "listen").otherwise("")
    full = _with_people(spark, sf_dir).drop("is_vip", "is_muted").withColumn("user_messages", (i % 7 == 6).cast("int"))
    heads = F.map_filter(F.create_map(F.lit("auto-submitted"), auto, F.lit("precedence"), said, F.lit("authentication-results"), F.coalesce(F.col("headers")["authentication-results"], F.lit(""))), lambda k, v: v != "")
    people = full.select(F.col("from.email").alias("email")).distinct()
    rules = people.select(F.upper("email").alias("email"), F.startswith("email", F.lit("src1@en")).alias("is_vip"), F.startswith("email", F.lit("src2@")).alias("is_muted"))
    marked = with_rules(people, rules).withColumnRenamed("email", "__who")
    judged = classify(full.withColumn("headers", heads).join(marked, F.col("from.email") == F.col("__who")), OWN, as_of=_as_of())
    first = F.col("reasons")[0]
    return judged.select("uid", F.when(first["decisive"], first["code"]).otherwise("weighted").alias("rule"))
