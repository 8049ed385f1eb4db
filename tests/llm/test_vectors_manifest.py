"""Hard negatives, the multi-index and the manifest, against brute force and on odd input."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermill.llm import multiindex, negatives
from lettermill.llm import queries as Q
from lettermill.llm.manifest import lowered, merkle_manifest, starts
from lettermill.llm.multiindex import nearest, pairs
from lettermill.llm.negatives import hard_negatives

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, id string, cell string, g int, v string, score int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank int, g string"
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op11_negatives", "op13_manifest"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


# --- vectors ------------------------------------------------------------------


def vectors(spark, rows):
    """Rows with further columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "x", "y", 1, "z", 2) for i, v, label in rows], VECTORS)


def usable(rows):
    found = {}
    for i, v, label in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            found.setdefault(i, []).append((label, list(map(float, np.float32(v)))))
    return found


def negatives_by_hand(rows):
    rows = {i: min(((lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v]) for lab, v in own) for i, own in usable([r for r in rows if r[2] is not None]).items()}
    out = set()
    for a, (label, q) in rows.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), i, lab) for i, (lab, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [(n, i) for n, i, lab in scored if lab != label and 80 * -s <= 100 * -n <= 100 * -s][:5]
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(near, 1)}
    return out


def clustered(n, seed, dim=6):
    """Vectors of several lengths, a third of them near one point, copies and ties among them."""
    r = np.random.default_rng(seed)
    at = r.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = at[0] + 0.02 * r.normal(size=dim) if i % 3 == 0 else at[i % 5] * r.uniform(0.2, 3) + 0.3 * r.normal(size=dim)
        rows.append((int(i * 5), v if i % 11 else at[1], int(r.integers(0, 4)) if i % 3 else 1))
    return rows


ODD = [(3, None, 1), (None, [1.0] * 6, 1), (100, [0.5] * 6, None), (203, [1.0, None, 1, 1, 1, 1], 2), (204, [float("nan")] * 6, 2), (206, [float("inf")] * 6, 2), (207, [0.0] * 6, 2), (700, [1.0, 2.0], 1), (208, [], 1), (1400, [9.0] * 9, 3)]


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 7)  # several groups a cell and buckets a group
    monkeypatch.setattr(negatives, "BUCKET", 90)
    rows = clustered(900, 1) + ODD
    rows += [rows[20], rows[20], (100, [0.1] * 6, 0)]
    got = [tuple(r) for r in hard_negatives(vectors(spark, rows)).collect()]
    want = negatives_by_hand(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_hard_negatives_of_large_numbers(spark):
    rows = [(i, v * 3e5, label) for i, v, label in clustered(300, 2)]
    assert {tuple(r) for r in hard_negatives(vectors(spark, rows)).collect()} == negatives_by_hand(rows)


def test_bounds_keep_rows_away(spark, monkeypatch):
    """Far clusters aren't replicated to groups that can't need them."""
    r = np.random.default_rng(3)
    at = np.eye(8) * 10
    rows = [(i, at[i % 8] + 0.01 * r.normal(size=8), i % 2) for i in range(4000)]
    made = []
    joined = negatives._joined
    monkeypatch.setattr(negatives, "_joined", lambda rows, anchors, links, by, *rest: made.append(rows.join(links, by).where("far between low and high").count()) or joined(rows, anchors, links, by, *rest))
    assert {tuple(x) for x in hard_negatives(vectors(spark, rows)).collect()} == negatives_by_hand(rows)
    assert len(made) == 3 and made[1] == 0 and made[2] <= 4000  # home, away, window: of 8 x 4000 at most


@pytest.mark.parametrize("rows", [[], [(100, [1.0], 1)], ODD])
def test_few_vectors(spark, rows):
    assert {tuple(r) for r in hard_negatives(vectors(spark, rows)).collect()} == negatives_by_hand(rows)
    assert nearest(vectors(spark, rows)).columns == ["query_id", "rank", "vec_id", "score"]
    nearest(vectors(spark, rows)).collect()


def nearest_by_hand(rows, k=20):
    rows = {i: np.array(min(v for _, v in own)) for i, own in usable(rows).items() if any(x for x in own[0][1])}
    out = {}
    for a, q in rows.items():
        if a % 20 == 0:
            pad = [(i, v) for i, v in rows.items() if i != a]
            out[a] = sorted(((-sum(x * y for x, y in zip(q.tolist(), v.tolist(), strict=False)), i) for i, v in pad))[:k]
    return out


def recall(got, want):
    return np.mean([len({r.vec_id for r in got if r.query_id == a} & {i for _, i in found}) / max(len(found), 1) for a, found in want.items()])


def test_nearest_recall_on_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = Q.op12_nearest(spark, SF).collect()
    assert recall(got, nearest_by_hand(rows)) >= 0.9


def test_nearest_in_clusters(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SHARD", 64)  # cells over several shards
    rows = clustered(1500, 4) + ODD + clustered(3, 4)
    got, want = nearest(vectors(spark, rows)).collect(), nearest_by_hand(rows)
    assert recall(got, want) >= 0.97
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(want)
    for a, own in by.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, len(want[a]) + 1))
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)  # nearest first, ties by id
        exact = dict((i, -s) for s, i in want[a])
        assert all(abs(exact[i] - s) < 1e-9 for _, i, s in own if i in exact)


def test_a_wide_search_is_exact(spark):
    rows = clustered(600, 5)
    got, want = nearest(vectors(spark, rows), width=1e6).collect(), nearest_by_hand(rows)
    assert recall(got, want) == 1
    assert nearest(vectors(spark, [(0, [1e-30] * 3, 1), (20, [3e38] * 3, 1), (40, [-3e38] * 3, 1)])).count() == 6


def test_pairs_come_by_sum():
    r = random.Random(1)
    one, two = np.array([r.randint(0, 9) for _ in range(13)], float), np.array([r.randint(0, 9) for _ in range(7)], float)
    found = list(pairs(one, two))
    assert [t for t, _, _ in found] == sorted((a + b for a in one for b in two))
    assert {(i, j) for _, i, j in found} == {(i, j) for i in range(13) for j in range(7)} and all(one[i] + two[j] == t for t, i, j in found)


# --- manifest -----------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest_by_hand(rows):
    def leaf(r, text):
        return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*r[:4], text)))

    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    for own in groups.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r, r[4]) for r in groups[g]]) for g in groups}
    top = tree([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            text = r[4].translate(LOWER) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[4]
            now, siblings = leaf(r, text), ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run, p = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    left, right = "".join(run[:p]), "".join(run[p + 1 :])
                    siblings, now, at = siblings + left + right, digest(left + now + right), at // 8
            out.append((r[0], leaf(r, r[4]), trees[g][-1][0], top[-1][0], digest(siblings), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return sorted((tuple(r) for r in merkle_manifest(docs, F.when(hit, lowered(F.col("text"))).otherwise(F.col("text"))).collect()), key=repr)


SAME_ID = [(77, "s", "zz", 1, f"T{i}") for i in range(70)]
ODD_DOCS = [
    (None, None, None, None, None), (None, None, None, None, "A"), (None, None, None, None, "A"), (5, "s", "", 1, ""), (5, "s", "", 1, "B"), (5, "s", "", 1, "B"),
    (-7, "s", "", 3, "C"), (2**62, "s", "é", 3, "C"), (-(2**63), "s", "é", 3, "Cé😀"), (2**63 - 1, "s", "é", 3, "X" * 100_000), (0, "s", "é", 0, "Q"), *SAME_ID, *SAME_ID[:9], *[(9, "s", "zz", 1, "copy")] * 7,
]


@pytest.mark.parametrize("count", [0, 1, 9, 65, 513])
def test_manifest_sizes(spark, count):
    rows = [(i * 7919 % 100_003, "s", "l", i, f"Text {i}") for i in range(count)]
    assert manifest(spark, rows) == manifest_by_hand(rows)


def test_manifest_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.manifest.COPIES", 2)
    rows = ODD_DOCS + [(i, "s", f"l{i % 70:02}", i, f"T{i}") for i in range(300)]
    assert manifest(spark, rows) == manifest_by_hand(rows)


def test_starts_equal_sorting(spark):
    r = random.Random(2)
    keys = {(r.choice("ab"), "1%016X" % r.choice([r.getrandbits(64), r.getrandbits(12)])): r.randint(1, 5) for _ in range(800)}
    got = {(x.g, x.key): x.start for x in starts(spark.createDataFrame([(g, k, n) for (g, k), n in keys.items()], "g string, key string, n long"), (1, 5, 9, 13, 15)).collect()}
    for g in "ab":
        total = 0
        for key in sorted(k for h, k in keys if h == g):
            assert got[g, key] == total
            total += keys[g, key]


# --- windows that many items share --------------------------------------------


def test_shared_windows(spark, monkeypatch):
    """Items that begin alike: each window is looked up once, items and longest matches are as of each item alone."""
    from lettermill.llm import decontaminate as D

    monkeypatch.setattr(D, "AT_ONCE", 50)
    r = random.Random(6)
    opening = "read what stands below and answer the question that comes after it in a word".split()
    items = [(i, " ".join(opening + [f"q{r.randrange(30)}" for _ in range(12)] + opening[:14])) for i in range(60)] + [(60, items_text := "Only Four Words here"), (61, items_text)]
    texts = [" ".join([f"w{k}" for k in range(10)] + r.choice(items)[1].upper().split()[r.randrange(5) :] + [f"v{k}" for k in range(r.randrange(9))] + r.choice([[], opening, items_text.split()])) for _ in range(40)]
    got = D.find_contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for row in got:
        words, hit, owners, longest = texts[row.doc_id].lower().split(), set(), set(), 0
        for i, t in items:
            own = t.lower().split()
            n = min(13, len(own))
            found = [(p, q) for p in range(len(words) - n + 1) for q in range(len(own) - n + 1) if words[p : p + n] == own[q : q + n]]
            for p, q in found:
                size = n
                while p + size < len(words) and q + size < len(own) and words[p + size] == own[q + size]:
                    size += 1
                longest = max(longest, size)
                hit |= set(range(p, p + n))
            owners |= {str(i)} if found else set()
        assert (row.n_words, row.n_hit, row["items"], row.longest) == (len(words), len(hit), sorted(owners), longest)
    assert any(r.n_items > 50 for r in got) and any(r.longest > 20 for r in got)
