"""Folders from captured sessions, saved documents, drafts, actions written down first, capped events, epochs."""

import json

import pytest
from pyspark.sql import functions as F

from lettermill.functions.text import safe_json, text_blocks
from lettermill.operators.journal import epoch_changes, orphaned, runs, special_folders
from lettermill.operators.mailbox import carry_out, chosen, cost_notes, decisions_json, drafted, resolve_folders, scan, valid_cache
from lettermill.plans.mailbox import decisions
from lettermill.schemas import JOURNAL
from lettermill.sources.files import read_lines, read_people, read_voice
from lettermill.sources.mail import read_folders, told
from lettermill.streaming.poll import upsert_events

SF = "/root/testdata/sf0.001"


def test_told():
    assert told(b'* LIST (\\HasNoChildren \\Sent) "/" "Sent Mail"') == [{"kind": "list", "name": "Sent Mail", "flags": ["\\HasNoChildren", "\\Sent"], "delimiter": "/"}]
    assert told(b"* LIST () NIL INBOX")[0]["delimiter"] == "/"
    assert [r["number"] for r in told(b"* SEARCH 3 0 x -2 17")] == [3, 17]
    assert told(b"* 12 EXISTS") == [{"kind": "exists", "number": 12}]
    assert told(b"a1 OK [UIDVALIDITY 99] done") == told(b"* OK [UIDVALIDITY 99] done") == [{"kind": "epoch", "number": 99}]
    assert told(b"* SEARCH") == told(b"* LIST () NIL \"\"") == told(b"* BYE") == told(b"") == []


def test_folders_of_a_session(spark, tmp_path):
    lines = ['* LIST (\\Sent) "/" "Out box"', '* LIST () "/" Drafts', "* 3 EXISTS", "* OK [UIDVALIDITY 7] ok", "* SEARCH 5 9", "a2 OK done"]
    (tmp_path / "s.log").write_bytes(("\r\n".join(lines) + "\r\n").encode())
    rows = read_folders(spark, str(tmp_path))
    assert [(r.kind, r.name, r.number) for r in rows.orderBy("position", "number").collect()] == [("list", "Out box", None), ("list", "Drafts", None), ("exists", None, 3), ("epoch", None, 7), ("found", None, 5), ("found", None, 9)]
    found = special_folders(rows.where("kind = 'list'"), {"sent": ("\\Sent", "^sent"), "drafts": ("\\Drafts", "^Drafts$")})
    named = {r.kind: r.name for r in resolve_folders(spark.createDataFrame([("noise", "Junk")], "kind string, name string"), found).collect()}
    assert named == {"inbox": "INBOX", "sent": "Out box", "drafts": "Drafts", "later": "Later", "brief": "Brief", "noise": "Junk"}


def test_scan_takes_the_newest(spark):
    day = lambda d: F.timestamp_seconds(F.lit(86_400) * d)
    mail = spark.range(10).select(F.col("id").alias("uid"), F.lit("INBOX").alias("folder"), day(F.col("id")).alias("date"))
    boxes = resolve_folders(*[spark.createDataFrame([], "kind string, name string")] * 2)
    assert sorted(r.uid for r in scan(mail, boxes, "inbox", day(F.lit(9)), 5, 3).collect()) == [7, 8, 9]
    assert scan(mail, boxes, "inbox", day(F.lit(9)), 5).count() == 6
    assert scan(mail, boxes, "sent", day(F.lit(9)), 5).count() == 0


def test_saved_documents(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"people": {"a@x": {"sentAt": [1, 2], "name": "A"}, "b@x": {}}, "vips": []}, indent=1))
    people = {r.email: r for r in read_people(spark, str(tmp_path / "g.json")).collect()}
    assert people["a@x"].sent_ms == [1, 2] and people["a@x"].received_ms == [] and people["b@x"].name == ""
    (tmp_path / "none.json").write_text("{}")
    assert read_people(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "voice.md").write_text("# Voice\n\nshort\n")
    assert read_voice(spark, str(tmp_path / "voice.md")).first().voice == "# Voice\n\nshort\n"


def test_drafts(spark):
    from lettermill.operators.batches import projections
    from lettermill.plans.mailbox import OWN, messages

    some = projections(messages(spark, SF).where("uid < 6"), OWN)

    def writer(item, voice):
        if item["subject"].startswith("Re:"):
            raise RuntimeError("no")
        return f"{voice}|{item['id']}|{item['domain']}"

    rows = {r.uid: r for r in drafted(some, writer, "v" * 5000).collect()}
    assert len(rows) == 6 and rows[1].body is None and rows[1].warning == "no draft: no"
    assert rows[0].body.startswith("v" * 4000 + "|0|") and rows[0].warning is None
    with pytest.raises(ValueError):
        drafted(some, chosen({"provider": "None"}, {}))
    assert chosen({"provider": "Mine", "x": 2}, {"mine": lambda s: lambda item, voice: s["x"]})({}, "") == 2
    with pytest.raises(ValueError):
        chosen({"provider": "other"}, {"mine": None})


def test_intents_come_first(spark, tmp_path):
    path = str(tmp_path / "journal")
    actions = spark.createDataFrame([(u, "move", None, "INBOX", "Later", None, None) for u in range(5)], "uid long, action string, messageId string, `from` string, `to` string, flags array<string>, label string")
    seen = []

    def do(rows):
        seen.append(read_lines(spark, path, JOURNAL).where("phase = 'intent'").select(F.explode("actions")).count())
        return rows.withColumns({"applied": F.col("uid") != 3, "error": F.when(F.col("uid") == 3, F.repeat(F.lit("x"), 600))})

    carry_out(actions, do, "r1", path, F.timestamp_seconds(F.lit(0)), 2)
    lines = read_lines(spark, path, JOURNAL)
    assert seen == [5] and lines.where("phase = 'intent'").count() == 3
    one = runs(lines).first()
    assert (one.n_intents, one.applied, one.ts) == (5, 4, "1970-01-01T00:00:00.000Z") and orphaned(runs(lines).withColumn("undone", F.lit(False))).count() == 1
    assert sorted(a.uid for a in one.intents) == list(range(5)) and one.intents[0].label == "" and one.intents[0].flags == []
    assert lines.where("error is not null").first().error == "x" * 500

    def breaks(rows):
        raise OSError

    with pytest.raises(OSError):
        carry_out(actions, breaks, "r2", path, F.timestamp_seconds(F.lit(1)))
    left = {r.runId: r for r in runs(read_lines(spark, path, JOURNAL)).collect()}["r2"]
    assert (left.n_intents, left.applied) == (5, 0)


def test_events_are_capped_over_batches(spark):
    batch = lambda a, b: spark.range(a, b).select(F.lit("a@x").alias("email"), F.lit("x").alias("domain"), F.lit("sent").alias("direction"), F.col("id").alias("ts_ms"), F.lit("").alias("name"), F.col("id").alias("seq"))
    state = upsert_events(batch(0, 4), batch(3, 9), 5)
    assert sorted(r.seq for r in state.collect()) == [4, 5, 6, 7, 8]
    assert upsert_events(batch(0, 0), batch(0, 0), 5).count() == 0


def test_a_new_epoch_empties_the_cache(spark):
    cache, stored = spark.range(3), spark.createDataFrame([("INBOX", 1)], "folder string, epoch long")
    told_now = lambda *rows: epoch_changes(spark.createDataFrame(list(rows), "folder string, epoch long"), stored)
    assert valid_cache(cache, told_now(("INBOX", 1), ("New", 5))).count() == 3
    assert valid_cache(cache, told_now(("INBOX", 2), ("New", 5))).count() == 0


def test_texts(spark):
    row = spark.range(1).select(
        text_blocks(F.lit(None).cast("array<struct<type: string, text: string>>")).alias("none"), safe_json(F.lit('x {"label": "now"} y'), "label string").alias("j"), safe_json(F.lit("{"), "label string").alias("bad")
    ).first()
    assert row.none == "" and row.j.label == "now" and row.bad is None
    totals = cost_notes(spark.createDataFrame([], "phase string, type string, usd double, input long, output long, calls long")).first()
    assert tuple(totals) == (0.0, 0, 0, 0, 0)


def test_decisions_as_json(spark):
    d = decisions(spark, SF)
    wanted = {r.uid: r for r in d.select("uid", "messageId", "label", "confidence", "tier", "reasons").collect()}
    got = decisions_json(d).collect()
    assert len(got) == len(wanted)
    for r in got:
        w = wanted[r.uid]
        assert json.loads(r.json) == {"uid": w.uid, "messageId": w.messageId, "label": w.label, "confidence": w.confidence, "tier": w.tier, "reasons": [{"code": x.code, "detail": x.detail} for x in w.reasons]}
