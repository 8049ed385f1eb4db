"""Mail parsing, classification of hand-made messages, journal and streams."""

import json

import pytest
from pyspark.sql import functions as F

from lettermill.config import LABELS, Config
from lettermill.functions.mime import with_structure
from lettermill.functions.numbers import clamp01, half_up, header_date, imap_date, money
from lettermill.functions.redact import redacted
from lettermill.functions.text import html_to_text, safe_json
from lettermill.operators.backtest import backtest, summary, totals
from lettermill.operators.asof import latest_before
from lettermill.operators.batches import Refused, TooLarge, ask, asked, batches, confidence, digest, projections, stub_provider
from lettermill.operators.cascade import classify
from lettermill.operators.correspondents import capped, domain_stats, edges, person_stats, reply_latencies, thread_index
from lettermill.schemas import JOURNAL
from lettermill.sources.files import append_lines, from_cached, merged, read_lines, to_cached
from lettermill.operators.triage import brief, shown, triage, why, with_statistics
from lettermill.sources.mail import classify_response, normalize, read_transcripts, responses, since, tokens
from lettermill.streaming.poll import poll, upsert_last

ME = "me@home.example"


def mail(sender, subject="s", body="b", to=ME, extra="", mid="<1@x>", date="Mon, 3 Aug 2026 10:00:00 +0000"):
    return f"From: {sender}\r\nTo: {to}\r\nSubject: {subject}\r\nMessage-ID: {mid}\r\nDate: {date}\r\n{extra}\r\n{body}\r\n"


def kept(spark, messages, path):
    """Messages as a sync leaves them: in a table."""
    messages.write.mode("overwrite").parquet(f"file://{path}")
    return spark.read.parquet(f"file://{path}")


@pytest.fixture(scope="module")
def inbox(spark, tmp_path_factory):
    raw = [
        (1, mail("News <news@shop.example>", extra="List-Id: <l>\r\n")),
        (2, mail("robot@x.example", extra="Auto-Submitted: auto-generated\r\n", mid="<2@x>")),
        (3, mail('"Fox, Ann" <Ann@Pals.example>', "Re: plan", "can you come?", extra="References: <root@home> <x@y>\r\n", mid="<3@x>")),
        (4, mail("ann@pals.example", "=?utf-8?B?w6nDqQ==?=", "see you", extra="Authentication-Results: mx; dmarc=fail\r\n", mid="<4@x>")),
        (5, mail("cold@new.example", "offer", "could you answer asap?", mid="<5@x>")),
        (None, mail("gone@x.example")),
        (7, None),
    ]
    rows = spark.createDataFrame(raw, "uid long, raw string").withColumns({"flags": F.array().cast("array<string>"), "internalDate": F.lit(None).cast("timestamp"), "size": F.lit(0)})
    return kept(spark, normalize(rows).withColumn("seq", F.col("uid")), tmp_path_factory.mktemp("inbox"))


@pytest.fixture(scope="module")
def sent(spark, tmp_path_factory):
    raw = [(i, mail(ME, to=to, mid=f"<s{i}@home>", extra=extra, date=date)) for i, to, extra, date in (
        (11, "ann@pals.example", "References: <root@home>\r\n", "Sat, 1 Aug 2026 09:00:00 +0000"),
        (12, "ann@pals.example, bob@pals.example", "", "Sun, 2 Aug 2026 09:00:00 +0000"),
        (13, "ann@pals.example", "", "Tue, 4 Aug 2026 09:00:00 +0000"),
    )]
    rows = spark.createDataFrame(raw, "uid long, raw string").withColumns({"flags": F.array().cast("array<string>"), "internalDate": F.lit(None).cast("timestamp"), "size": F.lit(0)})
    return kept(spark, normalize(rows, "Sent").withColumn("seq", F.col("uid")), tmp_path_factory.mktemp("sent"))


def test_normalize(inbox):
    got = {r.uid: r for r in inbox.collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert (got[3]["from"].name, got[3]["from"].email, got[3]["from"].domain) == ("Fox, Ann", "ann@pals.example", "pals.example")
    assert got[3].threadId == "<root@home>" and got[1].threadId == "<1@x>" and got[4].subject == "éé"
    assert got[1].headers["list-id"] == "<l>" and got[3].bodyText == "can you come?" and got[3].hasBody
    assert got[7]["from"].email == "" and got[7].date.year == 1970 and not got[7].hasBody


def test_multipart(spark):
    raw = "From: a@b.c\nSubject: x\nContent-Type: multipart/mixed; boundary=\"q;q\"\n\n--q;q\nContent-Type: text/html\n\n<p>Tom &amp; <b>J</b></p>\n--q;q\nContent-Type: text/plain; name=f.txt\nContent-Disposition: attachment; filename=f.txt\n\nhi\n--q;q--\n"
    row = normalize(spark.createDataFrame([(1, raw)], "uid long, raw string").withColumns({"flags": F.lit(None).cast("array<string>"), "internalDate": F.lit(None).cast("timestamp"), "size": F.lit(5)})).first()
    assert row.bodyText == "Tom & J" and [a.filename for a in row.attachments] == ["f.txt"] and row.flags == [] and row.size == 5


def test_stats_are_point_in_time(spark, inbox, sent):
    g = edges(inbox, sent)
    at = int(sent.where("uid = 12").select(F.unix_millis("date")).first()[0])
    assert {r.email: r.sent_to for r in person_stats(g).collect()}["ann@pals.example"] == 3
    assert {r.email: r.sent_to for r in person_stats(g, at).collect()}["ann@pals.example"] == 1
    assert {r.domain: r.domain_sent_to for r in domain_stats(g).collect()} == {"pals.example": 4}
    assert thread_index(sent).where("threadId = '<root@home>'").first().user_messages == 1
    assert reply_latencies(inbox, sent).count() == 0


def enriched(inbox, sent):
    stats = person_stats(edges(inbox, sent)).drop("name").withColumnRenamed("email", "e")
    d = domain_stats(edges(inbox, sent)).withColumnRenamed("domain", "d")
    full = inbox.join(stats, F.col("from.email") == F.col("e"), "left").join(d, F.col("from.domain") == F.col("d"), "left").join(thread_index(sent), "threadId", "left")
    return full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sent_to", "received_from", "domain_sent_to", "user_messages")} | {"is_vip": F.col("from.email") == "vip@x", "is_muted": F.lit(False), "median_latency_ms": F.lit(None).cast("double")})


def test_cascade(inbox, sent):
    got = {r.uid: r for r in classify(enriched(inbox, sent), [ME], as_of=F.lit("2026-08-05 12:00:00").cast("timestamp")).collect()}
    code = {u: r.reasons[0].code for u, r in got.items()}
    assert (code[1], code[2], code[3], code[4]) == ("bulk", "auto-submitted", "thread-participant", "impersonation")
    assert got[5].label == "now" and got[5].escalate and [r.code for r in got[5].reasons] == ["addressing:direct", "urgency-cue", "direct-question", "first-contact"]
    assert got[5].confidence == 0.718 and got[5].score_now == 4.5 and got[5].score_later == 1.0 and got[5].reasons[1].weight == {"now": 1.5}
    assert got[7].label == "later" and not got[1].escalate


def test_future_never_changes_the_past(inbox, sent):
    as_of = F.lit("2026-09-01 00:00:00").cast("timestamp")
    before = {r.uid: (r.predicted, r.confidence) for r in backtest(inbox, sent, [ME], as_of).collect()}
    later = sent.withColumns({"date": F.col("date") + F.expr("interval 60 days"), "uid": F.col("uid") + 100, "seq": F.col("seq") + 100})
    after = {r.uid: (r.predicted, r.confidence) for r in backtest(inbox, sent.unionByName(later), [ME], as_of).collect()}
    assert before == after
    assert totals(backtest(inbox, sent, [ME], as_of)).first().total == 6


def test_batches_and_provider(inbox):
    b = batches(projections(inbox, [ME]), Config(batch_size=4)).cache()
    assert sorted(r.messages for r in b.collect()) == [2, 4]
    assert list(json.loads(b.orderBy("batch").first().serialized)[0]) == ["id", "from", "domain", "subject", "date", "addressedAs", "recipientCount", "attachments", "preview", "truncated"]
    assert {r.uid for r in ask(b, stub_provider).collect()} == {1, 2, 3, 4, 5, 7}

    def broken(items):
        raise RuntimeError

    assert ask(b, broken).count() == 0


def test_redaction(spark):
    text = "key sk-abcdefghijklmnopqrstuvwx, your verification code is 123456, card 4111-1111-1111-1111 not 4111111111111112, token eyJabcdefgh.eyJabcdefgh.abcdefghi"
    row = redacted(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert row[0].redacted == "key [REDACTED:api-key], your verification code is [REDACTED:otp], card [REDACTED:card-number] not 4111111111111112, [REDACTED:bearer-token]"
    assert row[0].redactions["bearer-token"] == 1 and row[0].redactions["jwt"] == 0 and row[1].redacted is None


def test_scalars(spark):
    one = spark.range(1)
    row = one.select(
        half_up(F.lit(2.5)), half_up(F.lit(-2.5)), clamp01(F.lit("7")), clamp01(F.lit("x")), clamp01(F.lit("0")), imap_date(F.lit("2026-08-01").cast("timestamp")), header_date(F.lit("Sat, 1 Aug 2026 10:00:00 +0200")).cast("string"),
        header_date(F.lit("nonsense")), html_to_text(F.lit("<style>x</style>A &amp;lt; B&#8212;&#x;<br>C&#1114112;")), safe_json(F.lit('say {"a": 1} ok'), "a int")["a"], safe_json(F.lit("no"), "a int"), money(F.lit(0.001)), money(F.lit(2.0)),
    ).first()
    assert list(row) == [3, -2, 1.0, 0.5, 0.0, "01-Aug-2026", "2026-08-01 08:00:00", None, "A < B—&#x;\nC", 1, None, "$0.0010", "$2.00"]


def test_cache_and_journal_files(spark, inbox, tmp_path):
    path = str(tmp_path / "cache")
    append_lines(to_cached(inbox), path)
    (tmp_path / "cache" / "zz.json").write_text('{"uid": 9}\nbroken{\n\n{"uid": 10}\n')
    back = from_cached(read_lines(spark, path, to_cached(inbox).schema))
    assert {r.uid for r in back.collect()} == {1, 2, 3, 4, 5, 7, 9, 10} and back.where("uid = 9").first().flags == []
    (tmp_path / "j.jsonl").write_text('{"runId": "a", "phase": "intent", "actions": [{"action": "flag", "uid": 1}]}\nnot json\n')
    assert read_lines(spark, str(tmp_path / "j.jsonl"), JOURNAL).first().actions[0].action == "flag"
    assert merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 3}, "d": [2], "e": None}) == {"a": {"b": 3, "c": 2}, "d": [2]}


def test_transcripts(spark, tmp_path):
    raw = b"From: a@b.c\r\nSubject: hi\r\n\r\nbody"
    data = b'* 1 FETCH (UID 101 FLAGS (\\Seen $x) INTERNALDATE " 1-Aug-2026 10:00:00 +0000" RFC822.SIZE 30 BODY[] {%d}\r\n%s)\r\na1 OK done\r\n* 2 EXISTS\r\n' % (len(raw), raw)
    (tmp_path / "t.bin").write_bytes(data)
    rows = read_transcripts(spark, str(tmp_path / "t.bin")).collect()
    assert len(rows) == 1 and (rows[0].uid, rows[0].flags, rows[0].size, rows[0].raw) == (101, ["\\Seen", "$x"], 30, raw.decode()) and rows[0].internalDate.day == 1
    assert len(list(responses(data))) == 3 and [classify_response(r) for r in responses(data)] == ["untagged", "OK", "untagged"]
    assert tokens(b'A NIL "q\\"x" (b (c))') == [b"A", None, b'q"x', [b"b", [b"c"]]] and classify_response(b"+ go") == "continuation"
    assert since(normalize(read_transcripts(spark, str(tmp_path / "t.bin"))), F.lit("2026-08-03 00:00:00").cast("timestamp"), 2).count() == 1


def test_poll_reads_each_file_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    schema, seen = StructType.fromDDL("k int, seq int"), []
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text(json.dumps({"k": i, "seq": i}))
        poll(spark, str(src), schema, str(tmp_path / "cp"), lambda df, n: seen.extend(r.k for r in df.collect()))
    assert seen == [0, 1]
    a = spark.createDataFrame([(1, 1), (2, 1)], schema)
    assert {(r.k, r.seq) for r in upsert_last(a, spark.createDataFrame([(1, 5)], schema), "k", "seq").collect()} == {(1, 5), (2, 1)}


def test_asof_across_stretches(spark):
    import random

    rnd = random.Random(2)
    left = [(rnd.choice("ab"), rnd.randrange(200), i) for i in range(150)]
    right = [(rnd.choice("ab"), rnd.randrange(200), 1000 + i) for i in range(60)]
    got = latest_before(spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v long"), ["k"], "t", "v", "hit", width=7).collect()
    for r in got:
        earlier = [(t, -v) for k, t, v in right if k == r.k and t < r.t]
        want = max(earlier, default=None)
        assert (r.hit, r.hit_at) == ((None, None) if want is None else (-want[1], want[0]))
    assert len(got) == len(left)


NAMED = """From: a@b.c
Content-Type: multipart/mixed; boundary=q

--q
Content-Type: multipart/alternative; boundary=z

--z
Content-Type: text/plain; name=body.txt

named but text
--z
Content-Type: application/pdf; name=late.pdf

x
--z--
--q
Content-Disposition: attachment

cargo
--q
Content-Type: image/png

12345
--q--
"""


def test_parts_are_told_apart(spark):
    late = "From: a@b.c\nContent-Type: multipart/mixed; boundary=q\n\n--q\nX: y\n\n" + "x" * (3 << 20) + "\n--q\nContent-Disposition: attachment; filename=end.bin\n\nz\n--q--\n"
    got = spark.createDataFrame([(0, NAMED), (1, late)], "i int, raw string").transform(with_structure, F.col("raw"), "s").orderBy("i").collect()
    assert got[0].s.text.strip() == "named but text"  # a name alone doesn't make text cargo; alternatives end with the first text
    assert [(a.filename, a.contentType) for a in got[0].s.attachments] == [("(unnamed)", "text/plain"), ("(inline)", "image/png")]
    assert [a.filename for a in got[1].s.attachments] == ["end.bin"] and len(got[1].s.text) == 2 << 20


def test_triage_end_to_end(spark, inbox, sent):
    at = F.lit("2026-08-05 12:00:00").cast("timestamp")
    rules = spark.createDataFrame([("VIP@x", True, False), ("x@y", False, True)], "email string, is_vip boolean, is_muted boolean")
    known = with_statistics(inbox, sent, at, rules).cache()
    bodies = inbox.select("uid", F.lit("the fetched body").alias("bodyText"), "attachments")
    run = triage(known, [ME], at, stub_provider, bodies)
    got = {r.uid: r for r in run.decisions.collect()}
    alone = {r.uid: r for r in triage(known, [ME], at).decisions.collect()}
    assert set(got) == set(alone) == {1, 2, 3, 4, 5, 7} and any(r.escalate for r in alone.values())
    for u, r in alone.items():
        assert (got[u].label, got[u].tier, got[u].confidence) == (("later", 1, 0.88) if r.escalate else (r.label, 0, r.confidence))
    unsure = [u for u, r in alone.items() if r.escalate]
    assert sorted(u for b in run.batches.collect() for u in b.uids) == sorted(unsure)
    assert all("the fetched body" in b.serialized for b in run.batches.collect()) and run.warnings.count() == 0
    assert "no model is configured" in triage(known, [ME], at).warnings.first().warning
    assert {r.code for r in why(run.decisions, unsure[0]).collect()} >= {"model"}
    assert {r.label for r in shown(run.decisions).collect()} == {r.label for r in got.values()}
    assert sum(r.n for r in brief(run.decisions).collect()) == sum(r.label == "brief" for r in got.values())


def test_rules_of_people(spark, inbox, sent):
    at = F.lit("2026-08-05 12:00:00").cast("timestamp")
    rules = spark.createDataFrame([("eve@nowhere.example", False, True), ("ann@pals.example", True, False)], "email string, is_vip boolean, is_muted boolean")
    known = with_statistics(inbox, sent, at, rules)
    marked = {r.uid: (r.is_vip, r.is_muted) for r in known.collect()}
    emails = {r.uid: r["from"].email for r in inbox.collect()}
    assert all(marked[u] == (e == "ann@pals.example", e == "eve@nowhere.example") for u, e in emails.items())


def test_providers_that_fail(spark, inbox):
    b = batches(projections(inbox, [ME]), Config(batch_size=4)).cache()

    def too_large(items):
        if len(items) > 2:
            raise TooLarge("too many")
        return stub_provider(items)

    def refuses(items):
        raise Refused

    def odd(items):
        return [{"id": 0}, {"id": 1, "label": "now", "confidence": "high"}, {"id": 0, "label": "now", "confidence": 7}, {"id": 99, "label": "now"}, "text", {"label": "now"}]

    assert {r.uid for r in ask(b, too_large).collect()} == {1, 2, 3, 4, 5, 7}
    assert ask(b, refuses).count() == 0 and asked(b, refuses).where("warning like 'model declined%'").count() == 2
    assert {(r.label, r.confidence) for r in ask(b, odd).collect()} == {("", 0.5), ("now", 0.5), ("now", 1.0)}
    said = {"missing": {}, "null": {"confidence": None}, "nan": {"confidence": float("nan")}, "inf": {"confidence": float("inf")}, "text": {"confidence": "0.25"}, "words": {"confidence": "high"}, "low": {"confidence": -3}, "list": {"confidence": [1, 2]}, "blank": {"confidence": " "}}
    assert {k: confidence(v) for k, v in said.items()} == {"missing": 0.5, "null": 0.0, "nan": 0.5, "inf": 0.5, "text": 0.25, "words": 0.5, "low": 0.0, "list": 0.5, "blank": 0.0}


def test_backtest_summary(spark):
    """All measures in one text; of nothing, rates are 0 and measures null."""
    schema = "predicted string, actual string, escalated boolean"
    none = json.loads(summary(spark.createDataFrame([], schema)).first().json)
    assert (none["total"], none["skipped"], none["agreementRate"], none["escalationRate"]) == (0, 0, 0.0, 0.0)
    assert [x["label"] for x in none["labels"]] == list(LABELS) and all(x["precision"] is None and x["recall"] is None for x in none["labels"])
    rows = [("now", "now", False), ("now", "brief", True), ("noise", "brief", False), ("brief", "brief", True), ("later", None, True), (None, "later", False)]
    s = json.loads(summary(spark.createDataFrame(rows, schema)).first().json)
    assert (s["total"], s["skipped"], s["agreed"], s["escalated"], s["agreementRate"], s["escalationRate"]) == (5, 1, 2, 2, 0.4, 0.4)
    assert {x["label"]: (x["predicted"], x["actual"], x["correct"], x["precision"], x["recall"]) for x in s["labels"]}["brief"] == (1, 3, 1, 1.0, 0.333333)
    assert {m["actual"]: (m["now"], m["later"], m["brief"], m["noise"]) for m in s["matrix"]}["brief"] == (1, 0, 1, 1)
    assert "scored" not in s


def test_hot_keys_in_parts(spark):
    """One sender of nearly all messages: its last events and first subjects as if ranked at once; ties and nulls too."""
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 7, F.concat(F.lit("p"), F.col("id") % 3)).when(F.col("id") % 100 == 9, F.lit(None).cast("string")).otherwise("hot").alias("email"), F.lit("received").alias("direction"), F.col("id").alias("seq"), F.concat(F.lit("s"), F.col("id")).alias("subject"))
    by = {}
    for r in rows.collect():
        by.setdefault(r.email, []).append(r.seq)
    kept = {}
    for r in capped(rows, 30).collect():
        kept.setdefault(r.email, []).append(r.seq)
    assert {k: sorted(v) for k, v in kept.items()} == {k: sorted(v)[-30:] for k, v in by.items()}
    got = {r.email: (r.first_seq, r.n, r.subjects, r.more) for r in digest(rows, "email").collect()}
    assert got == {k: (min(v), len(v), [f"s{x}" for x in sorted(v)[:5]], len(v) - 5) for k, v in by.items()}
    assert capped(rows, 30).columns == rows.columns and digest(rows.limit(0), "email").count() == 0
    twice = rows.where("seq < 3").unionByName(rows.where("seq < 3"))
    assert digest(twice, "email").first().subjects == ["s0", "s0", "s1", "s1", "s2"] and capped(twice, 4).count() == 4
