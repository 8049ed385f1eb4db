"""What survives failures: medians of hot keys, rules that fail, versions, providers that are asked again."""

import json
import os
import random
import statistics

import pytest
from pyspark.sql import functions as F

from lettermill.operators.batches import Ledger, Refused, TooLarge, Unavailable, asked, patient
from lettermill.operators.cascade import Decisive, Weighted, classify, weighted_rules
from lettermill.operators.correspondents import medians
from lettermill.operators.triage import with_statistics
from lettermill.plans.adapters import OWN
from lettermill.plans.triage import _with_people, rules_of_people
from lettermill.sources import versions

SF = "/root/testdata/sf0.001"


def test_medians_equal_sorting(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b"]), rnd.choice([rnd.randrange(50), rnd.randrange(1 << 20), rnd.randrange(1 << 45), 0])) for _ in range(3000)]
    rows += [("one", 7), ("two", 1), ("two", 4), ("same", 5), ("same", 5), ("none", None)]
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    got = {r.who: r.median for r in medians(spark.createDataFrame(rows, "who string, v long"), "who", "v").collect()}
    assert got == {k: statistics.median(v) for k, v in want.items()}


def person(email):
    return F.struct(F.lit("").alias("name"), F.lit(email).alias("email"), F.lit("x").alias("domain"))


def letters(spark, rows):
    df = spark.createDataFrame(rows, "seq long, who string, threadId string, hours double")
    date = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("hours") * 3600)
    return df.select(F.col("seq").alias("uid"), "seq", "threadId", date.alias("date"), F.struct(F.lit("").alias("name"), F.col("who").alias("email"), F.lit("x").alias("domain")).alias("from"), F.array(person("ann@x")).alias("to"), F.array().cast("array<struct<name: string, email: string, domain: string>>").alias("cc"))


def test_statistics_without_a_moment_know_latencies(spark):
    received = letters(spark, [(1, "ann@x", "t1", 0.0), (2, "ann@x", "t2", 10.0), (3, "Bob@x", "t3", 20.0)])
    sent = letters(spark, [(11, "me@x", "t1", 2.0), (12, "me@x", "t2", 16.0), (13, "me@x", "t4", 30.0)])
    got = {r.uid: r for r in with_statistics(received, sent).collect()}
    assert got[1].median_latency_ms == 4 * 3_600_000 and got[3].median_latency_ms is None and got[1].sent_to == 3 and got[1].user_messages == 1
    then = with_statistics(received, sent, F.timestamp_seconds(F.lit(1_700_000_000 + 5 * 3600))).collect()
    assert all(r.median_latency_ms is None for r in then) and {r.uid: r.sent_to for r in then}[1] == 1


def test_rules_of_people_fire(spark):
    got = rules_of_people(spark, SF).collect()
    assert any(r.fast for r in got) and any(r.first_contact for r in got) and any(r.failed_authentication for r in got)


def test_a_rule_that_fails_is_left_out(spark):
    people = _with_people(spark, SF)
    at = F.timestamp_seconds(F.lit(1_706_659_200))
    rules = weighted_rules(OWN, at)
    broken = Weighted(F.lit("broken"), F.lit(1) / F.size("headers").cast("int") > 0, F.lit("x"), {"now": F.lit(1) / (F.col("uid") % 2)})
    odd = Weighted(F.lit("odd"), F.col("from.email").cast("int") > 3, F.array("subject")[7], {"now": 5})
    never = Decisive("never", (F.lit(1) / F.lit(0)) > 0, F.lit("x"), "noise", 1.0)
    plain = {r.uid: r for r in classify(people, OWN, as_of=at).collect()}
    got = {r.uid: r for r in classify(people, OWN, as_of=at, weighted=[broken, odd, *rules]).collect()}
    assert set(got) == set(plain)
    for u, r in got.items():
        own = [x for x in r.reasons if x.code == "broken"]
        assert [x for x in r.reasons if x.code not in ("broken", "no-signal")] == [x for x in plain[u].reasons if x.code != "no-signal"]
        assert all(x.weight == ({} if u % 2 == 0 else {"now": 1.0}) for x in own)
    assert {r.uid: r.label for r in classify(people, OWN, as_of=at, decisive=[never]).collect()}.keys() == plain.keys()
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_versions(spark, tmp_path):
    path, rows = f"file://{tmp_path}/cache", lambda a, b: spark.range(a, b).select("id", (F.col("id") % 5).alias("k"))
    newest = lambda df: df.groupBy("k").agg(F.max("id").alias("id")).select("id", "k")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert not versions.append(rows(0, 10), path, newest) and versions.version(spark, path) == 1
    versions.append(rows(10, 20), path)
    assert versions.read(spark, path).count() == 20
    reader = versions.read(spark, path)

    def fails(df):
        return newest(df).withColumn("id", F.when(F.col("k") >= 0, F.raise_error("lost")).cast("long"))

    with pytest.raises(Exception, match="lost"):
        versions.compact(spark, path, fails)
    assert versions.version(spark, path) == 1 and versions.read(spark, path).count() == 20
    assert versions.append(rows(20, 25), path, newest, limit=1) and versions.version(spark, path) == 2
    assert sorted(r.id for r in versions.read(spark, path).collect()) == [20, 21, 22, 23, 24]
    assert reader.count() == 20  # who began with the earlier version ends with it
    versions.clear(spark, path)
    assert {"CURRENT", "v2"} <= set(os.listdir(tmp_path / "cache")) and not (tmp_path / "cache" / "v1").exists()


def test_providers_are_asked_again():
    waits, said = [], [Unavailable("busy"), Unavailable("busy", 3), ConnectionError("gone"), Unavailable("x", 1e9)]

    def provider(items):
        if said:
            raise said.pop(0)
        return ["fine"]

    assert patient(provider, 5, waits.append)([]) == ["fine"] and waits == [0.5, 3, 2.0, 60.0]
    said[:] = [Unavailable("a"), Unavailable("b")]
    with pytest.raises(Unavailable, match="b"):
        patient(provider, 1, waits.append)([])
    said[:] = [ValueError("no")]
    with pytest.raises(ValueError):
        patient(provider, 5, waits.append)([])


def test_ledger_keeps_what_was_said(tmp_path):
    calls = []

    def provider(items):
        calls.append(len(items))
        if len(items) > 2:
            raise TooLarge("many")
        if items == ["no"]:
            raise Refused("never")
        if items == ["fails"]:
            raise ValueError
        return [{"id": 0}]

    for _ in range(2):
        ask = Ledger(f"file://{tmp_path}/l").around(provider)
        assert ask(["a"]) == [{"id": 0}]
        for items, error in ((["a", "b", "c"], TooLarge), (["no"], Refused), (["fails"], ValueError)):
            with pytest.raises(error):
                ask(items)
    assert calls == [1, 3, 1, 1, 1]  # only the failure was asked again


def test_a_killed_task_asks_once(spark, tmp_path):
    """A worker dies in the middle of a task; the task's second run asks only for what wasn't answered."""
    items = [json.dumps([{"id": 0, "n": i}]) for i in range(6)]
    batches = spark.createDataFrame([([i], t) for i, t in enumerate(items)], "uids array<long>, serialized string").coalesce(1)
    calls, killed = str(tmp_path / "calls"), str(tmp_path / "killed")

    def provider(some):
        with open(calls, "a") as f:
            f.write(f"{some[0]['n']}\n")
        if some[0]["n"] == 4 and not os.path.exists(killed):
            open(killed, "w").close()
            os._exit(1)
        return [{"id": 0, "label": "now", "confidence": 1}]

    run = lambda: asked(batches, provider, ledger=f"file://{tmp_path}/ledger").collect()
    with pytest.raises(Exception):
        run()
    assert sorted(r.uid for r in run()) == [0, 1, 2, 3, 4, 5]
    assert sorted(open(calls).read().split()) == ["0", "1", "2", "3", "4", "4", "5"]


def test_unknown_labels_are_shown_as_later(spark):
    from lettermill.operators.triage import shown

    rows = spark.createDataFrame([(1, "now"), (2, "odd"), (3, "later"), (4, None)], "uid long, label string").select("uid", F.col("uid").alias("seq"), "label", F.lit(0).alias("tier"), F.lit("s").alias("subject"))
    assert sorted((r.label, r.place, r.uid, r.beyond) for r in shown(rows).collect()) == [("later", 1, 2, 0), ("later", 2, 3, 0), ("later", 3, 4, 0), ("now", 1, 1, 0)]


def test_nesting_is_bounded():
    from lettermill.sources.mail import tokens

    assert tokens(b"(" * 32 + b"x" + b")" * 32)
    with pytest.raises(ValueError, match="deep"):
        tokens(b"(" * 40 + b"x" + b")" * 40)


def test_people_and_voice_are_saved(spark, tmp_path):
    from lettermill.operators.correspondents import people
    from lettermill.sources.files import read_people_lines, read_voice, write_people, write_voice

    graph = spark.createDataFrame([("a@x", "sent", i * 10, "" if i < 2 else "Ann", i) for i in range(5)] + [("b@x", "received", 7, "", 9)], "email string, direction string, ts_ms long, name string, seq long")
    waits = spark.createDataFrame([("a@x", 5, 1), ("a@x", 3, 2), ("a@x", 9, 0)], "email string, latency_ms long, seq long")
    path = f"file://{tmp_path}/people"
    for _ in range(2):  # replaced, not added to
        write_people(people(graph, waits, 2), path)
    (tmp_path / "people" / "x.json").write_text('{"email": "c@x"}\nbroken{\n{"name": "none"}\n')
    got = {r.email: tuple(r)[1:] for r in read_people_lines(spark, path).collect()}
    assert got == {"a@x": ("Ann", [30, 40], [], [5, 3]), "b@x": ("", [], [7], []), "c@x": ("", [], [], [])}
    write_voice(spark.createDataFrame([("short, warm",)], "voice string").coalesce(1), f"file://{tmp_path}/voice")
    assert [r.voice.strip() for r in read_voice(spark, f"file://{tmp_path}/voice").collect() if r.voice.strip()] == ["short, warm"]
