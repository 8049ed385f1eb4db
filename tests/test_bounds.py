"""What bounds the mail readers: pieces that are worked on at once, streams, partitions."""

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lettermill.functions import octets
from lettermill.functions.mime import field, head_and_body, named
from lettermill.plans.mime import address_lists
from lettermill.plans.triage import rules_of_people
from lettermill.sources.mail import responses, streamed
from lettermill.sources.shared import small_batches

SF = "/root/testdata/sf0.001"


def test_empty_lines_are_found_behind_wide_characters(spark):
    raw = F.lit("Subject: \U0001f600\U0001f600 x\r\n y\r\nX-A : 1\r\nx-a: 2\r\n\r\n\r\nbody")
    got = spark.range(1).select(head_and_body(raw).alias("h")).select("h.body", *(field(named(F.col("h.head")), n).alias(n) for n in ("subject", "x-a", "none"))).first()
    assert got[:] == ("\r\nbody", "\U0001f600\U0001f600 x y", "1", "")


def test_few_bytes_are_decoded_at_once(monkeypatch):
    texts = [f"text {i} é" * (i % 5) for i in range(200)]
    encoded = [base64.b64encode(t.encode()).decode() for t in texts]
    seen = []
    plain = octets.base64
    monkeypatch.setattr(octets, "base64", lambda data, offsets: seen.append(len(data)) or plain(data, offsets))
    monkeypatch.setattr(octets.runs, "__defaults__", (300,))
    assert octets.bodies(pa.array(encoded), ["base64"] * 200, [None] * 200) == texts
    assert octets.words([f"=?utf-8?b?{e}?= {i}" for i, e in enumerate(encoded)]) == [f"{t} {i}" if e else f"=?utf-8?b??= {i}".replace("=?utf-8?b??=", "") for i, (t, e) in enumerate(zip(texts, encoded, strict=True))]
    assert max(seen) <= 300
    assert octets.split_outside(pa.array(['a,"b,c"', None, "d" * 400, ","]), ",").to_pylist() == [["a", '"b,c"'], [""], ["d" * 400], ["", ""]]
    assert octets.split_outside(pa.array([], pa.string()), ",").to_pylist() == []
    assert list(octets.runs(np.array([5, 400, 1]), 300)) == [(0, 1), (1, 2), (2, 3)]


def test_responses_of_a_stream():
    data = b"".join(b"* %d FETCH (UID %d BODY[] {%d}\r\n%s)\r\n" % (i, i, 7 * i, b"a\r\n{9}\r" * i) for i in range(40)) + b"* 41 FETCH (UID 41 BODY[] {99}\r\nshort"
    for size in (1, 3, 64, 1 << 20):
        at, asked = [0], []

        def read(n, at=at, asked=asked):
            asked.append(n)
            at[0] += n
            return data[at[0] - n : at[0]]

        assert list(streamed(read, size)) == list(responses(data)) and set(asked) == {size}


def test_customers_are_dealt_over_all_cores(spark):
    assert address_lists(spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_rules_are_judged_once(spark):
    plan = rules_of_people(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("promotional phrasing") == 1


def test_arrow_batches_of_mail_are_small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    small_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 1000
