"""Keys with a large share of the rows: joined in parts, with the results of a plain join."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lettermill.llm import common
from lettermill.llm.common import hubs, spread_join
from lettermill.llm.components import connected_components
from lettermill.llm.neardup import near_duplicates


@pytest.fixture
def low(monkeypatch):
    monkeypatch.setattr(common, "HUB_ROWS", 5)


def least_reached(pairs):
    of = {x: x for p in pairs for x in p}
    while True:
        before = dict(of)
        for a, b in pairs:
            of[a] = of[b] = min(of[a], of[b])
        if of == before:
            return of


def test_hubs_are_bounded(spark):
    counts = spark.range(100).select("id", (F.col("id") * 1000).alias("n"))
    assert hubs(counts, "id", common.HUB_ROWS - 1) is None
    got = {r.id: r.parts for r in hubs(counts, "id", 4_950_000).collect()}
    assert got == {i: -(-i * 1000 // common.HUB_ROWS) for i in range(10, 100)}
    # of very many rows, a key needs its share
    assert {r.id for r in hubs(counts, "id", 980_000_000).collect()} == {98, 99}


def test_spread_join_parts_a_hot_key(spark):
    rows = spark.range(2_000_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    keyed = rows.where("v % 7 < 5").select("k").distinct().withColumn("w", F.col("k") + 1)
    heavy = hubs(rows.groupBy("k").agg(F.count("*").alias("n")), "k", 2_000_000)
    assert [(r.k, r.parts) for r in heavy.collect()] == [(0, 100)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spread_join(rows, keyed, "k", "v", heavy)
        assert joined.columns == ["k", "v", "w"]
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
        assert joined.where("w <> k + 1").count() == 0
        assert sum(sizes) == rows.join(keyed, "k").count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_components_with_hubs(spark, low):
    rng = random.Random(5)
    pairs = [(7, i) for i in range(100, 160)] + [(i, 3) for i in range(160, 200)] + [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(i, i + 1) for i in range(2000, 2030)] + [(4, 4), (7, 100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = least_reached([p for p in pairs if p[0] != p[1]])
    assert got == linked


def test_near_duplicates_with_hubs(spark, low):
    """Copies of one text, near copies of it, empty texts and rows without an id, each more than a part holds."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words)] * 30 + [" ".join([*words, f"x{i}"]) for i in range(40)] + ["", None, " \n"] * 12 + [f"alone{i} " * 9 for i in range(10)]
    rows = [*enumerate(texts, 1), *((None, t) for t in texts[:40])]
    random.Random(3).shuffle(rows)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is None) == {(None, None, True): 40}
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == (1 if r.doc_id <= 70 else r.doc_id) and r.kept == (r.doc_id == r.component_id)
