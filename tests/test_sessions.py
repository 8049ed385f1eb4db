"""Captured sessions as a table and as a stream, and state by key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lettermill.operators.correspondents import capped
from lettermill.sources import sessions
from lettermill.sources.sessions import Session, SessionReader, register
from lettermill.streaming.state import last_events


def session(uids, day=lambda u: u % 28 + 1):
    out = b"* OK [UIDVALIDITY 7] fine\r\n"
    for n, u in enumerate(uids, 1):
        raw = f"Subject: UID {u * 1000}\r\n\r\nbody é {u}".encode()
        out += b'* %d FETCH (UID %d FLAGS (\\Seen) INTERNALDATE "%2d-Aug-2026 10:00:00 +0200" RFC822.SIZE %d BODY[] {%d}\r\n%s)\r\n' % (n, u, day(u), len(raw), len(raw), raw)
    return out + b"a1 OK done\r\n"


def put(root, folder, epoch, first, last):
    d = root / folder / str(epoch)
    d.mkdir(parents=True, exist_ok=True)
    (d / "part").write_bytes(session(range(first, last + 1)))
    (d / "part").rename(d / f"{first}-{last}.session")


def test_filters_are_pushed(spark, tmp_path):
    register(spark)
    put(tmp_path, "INBOX", 7, 1, 20)
    put(tmp_path, "INBOX", 7, 21, 40)
    put(tmp_path, "Sent", 9, 1, 5)
    (tmp_path / "other.bin").write_bytes(session([100]))
    rows = spark.read.format("mail_sessions").load(f"file://{tmp_path}")
    got = {(r.folder, r.epoch, r.uid): r for r in rows.collect()}
    assert len(got) == 46 and got["INBOX", 7, 3].raw.encode("latin-1").decode().endswith("body é 3") and got[None, None, 100].flags == ["\\Seen"]
    some = rows.where("uid between 18 and 23 and folder = 'INBOX'").where(F.col("internalDate") >= F.lit("2026-08-20 00:00:00").cast("timestamp"))
    assert sorted(r.uid for r in some.collect()) == [19, 20, 21, 22, 23]
    plan = some._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter (" in line]
    assert left and all("INBOX" in line and ">=" not in line and "<=" not in line for line in left)  # comparisons are the reader's
    assert rows.where("uid in (20, 39)").count() == 2 and rows.where("uid = 41").count() == 0 and rows.where("uid > 1000").count() == 0


def test_fewer_rows_are_parsed_and_files_read(tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    put(tmp_path, "INBOX", 7, 1, 20)
    put(tmp_path, "INBOX", 7, 21, 40)
    decoded = []
    real = sessions.fetched
    monkeypatch.setattr(sessions, "fetched", lambda d, w: [decoded.append(r) for r in [real(d, w)] if r] and decoded[-1])
    reader = SessionReader(f"file://{tmp_path}")
    other = StringContains(("raw",), "x")
    assert list(reader.pushFilters([GreaterThan(("uid",), 38), other])) == [other]
    parts = reader.partitions()
    assert [(p.first, p.last) for p in parts] == [(21, 40)]
    assert [r[4] for p in parts for r in reader.read(p)] == [39, 40] and len(decoded) == 2
    for filters, files in (([EqualTo(("uid",), 20)], [1]), ([In(("uid",), (3, 30))], [1, 21]), ([EqualTo(("uid",), 99)], [])):
        reader = SessionReader(f"file://{tmp_path}")
        assert list(reader.pushFilters(filters)) == []
        assert [p.first for p in reader.partitions() if p != Session("")] == files


def poll(spark, root, out, seen):
    rows = spark.readStream.format("mail_sessions").load(f"file://{root}")
    rows.writeStream.foreachBatch(lambda df, n: seen.extend((r.folder, r.epoch, r.uid) for r in df.collect())).option("checkpointLocation", str(out)).trigger(availableNow=True).start().awaitTermination()


def test_polling_loses_and_repeats_nothing(spark, tmp_path):
    register(spark)
    root, seen = tmp_path / "mail", []
    put(root, "INBOX", 7, 1, 10)
    put(root, "Sent", 3, 1, 4)
    poll(spark, root, tmp_path / "cp", seen)
    first = [("INBOX", 7, u) for u in range(1, 11)] + [("Sent", 3, u) for u in range(1, 5)]
    assert sorted(seen) == first
    poll(spark, root, tmp_path / "cp", seen)  # nothing new
    assert sorted(seen) == first
    put(root, "INBOX", 7, 11, 15)
    put(root, "New", 1, 1, 2)
    poll(spark, root, tmp_path / "cp", seen)
    assert sorted(seen) == sorted(first + [("INBOX", 7, u) for u in range(11, 16)] + [("New", 1, 1), ("New", 1, 2)])
    before = len(seen)
    put(root, "INBOX", 8, 1, 3)  # another epoch: the folder begins anew
    poll(spark, root, tmp_path / "cp", seen)
    assert sorted(seen[before:]) == [("INBOX", 8, u) for u in (1, 2, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_state_equals_the_whole_table(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [{"email": rnd.choice(["hot@x"] * 3 + ["a@x", "b@x"]), "direction": rnd.choice(["sent", "received"]), "epoch": None if seed == 1 else 1, "seq": i, "ts_ms": rnd.randrange(10**6)} for i in range(300)]
    if seed == 2:  # the second half of one direction is of a later epoch
        rows += [{**r, "epoch": 2, "seq": r["seq"] - 150} for r in rows if r["direction"] == "sent" and r["seq"] >= 150]
        rows += [{"email": "a@x", "direction": "sent", "epoch": 1, "seq": 999, "ts_ms": 5}]  # late, of the earlier epoch
    src, cut = tmp_path / "in", sorted(rnd.sample(range(1, len(rows)), 3))
    src.mkdir()
    parts = [rows[i:j] for i, j in zip([0, *cut], [*cut, len(rows)])]
    parts[-1] = parts[-1] + parts[0][:20] if seed == 1 else parts[-1]  # what comes again counts once
    for k, part in enumerate(parts):
        (src / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
    stream = spark.readStream.schema("email string, direction string, epoch long, seq long, ts_ms long").option("maxFilesPerTrigger", 1).json(str(src))
    last = {}
    last_events(stream, 20).writeStream.foreachBatch(lambda df, n: last.update({(r.email, r.direction): r for r in df.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    table = spark.createDataFrame([r for r in rows if seed == 1 or r["direction"] == "received" or r["epoch"] == 2], "email string, direction string, epoch long, seq long, ts_ms long")
    want = {}
    for r in capped(table, 20).collect():
        want.setdefault((r.email, r.direction), []).append((r.seq, r.ts_ms))
    got = {k: list(zip(r.seqs, r.times)) for k, r in last.items()}
    assert {k: v for k, v in got.items() if k in want} == {k: sorted(v) for k, v in want.items()}
