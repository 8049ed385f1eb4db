"""The training-data operators against brute force, libraries or held-out labels, and on odd input."""

import hashlib
import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lettermill.llm import licenses, neardup, toxicity
from lettermill.llm import queries as Q
from lettermill.llm.bpe import Tokenizer, bpe_decode, bpe_encode
from lettermill.llm.common import ALNUM, SPACED, Words
from lettermill.llm.components import connected_components
from lettermill.llm.decontaminate import decontaminate, find_contamination
from lettermill.llm.fingerprints import fingerprint_documents, fingerprint_edits
from lettermill.llm.html import MAIN, Page, common, extract_text, line_hash, page_lines, url_key
from lettermill.llm.licenses import notices, scan_licenses
from lettermill.llm.lines import drop_recurring_lines
from lettermill.llm.neardup import near_duplicates
from lettermill.llm.quality import score_quality, site_posteriors
from lettermill.llm.sharding import find_cuts, locate, shard_documents, write_shards
from lettermill.llm.toxicity import fit, score_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, kept string, h1 string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM_WORD, SPACED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def frame(spark, rows):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, None, None if i is None or i % 2 else "s", None, 1, "x", "y", "z", "h") for i, t in rows], SCHEMA)


LONG = "the quick brown fox jumps over the lazy dog again and again " * 3000
ODD = [(1, None), (2, ""), (3, "   \n\n "), (4, LONG), (5, "same text here today for all of us"), (6, "same text here today for all of us"), (7, "é" * 50), (8, "x"), (8, "x"), (9, "😀 <|endoftext|> ok")]


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


# --- words --------------------------------------------------------------------


@given(st.lists(st.text(alphabet="abAZ09 .\n\té中😀-_", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words(texts):
    for kind, pattern in ((ALNUM, ALNUM_WORD), (SPACED, SPACED_WORD)):
        w = Words([t.encode() for t in texts], kind)
        for i, t in enumerate(texts):
            want = re.findall(pattern, t.translate(LOWER))
            assert w.text(int(w.first[i]), int(w.first[i + 1])).decode().translate(LOWER).split(" ") == (want or [""])


# --- 1 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(Q.VOCAB)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer as Library

    t = Library.from_file(Q.VOCAB)
    t.no_padding()
    t.no_truncation()
    return t


@given(st.text(alphabet="aabcdehinorstABé'stΣİ 1²!?-\n\t中😀<|endoftext|>", max_size=60))
@settings(max_examples=500, deadline=None)
def test_bpe_equals_library(tok, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert list(array("I", tok.encode(text))) == want
    assert tok.decode(tok.encode(text)) == library.decode(want, skip_special_tokens=False)


@given(st.lists(st.text(alphabet="aehinst's1²é\u0301Σ\u00a0\u2003\x1c\x85 \n\U00010e7e中<|endoftext|>", max_size=80), max_size=8))
@settings(max_examples=200, deadline=None)
def test_bpe_of_many_texts_equals_library(tok, library, texts):
    got = tok.encode_all([x.encode() for x in texts])
    assert [list(array("I", x)) for x in got] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_bpe_takes_each_piece_of_a_run_once(docs, library, monkeypatch):
    tok, calls, learned = Tokenizer(Q.VOCAB), [], []
    normalize, encode_all = tok.normalize, tok.automaton.encode_all
    monkeypatch.setattr(tok, "normalize", lambda x: calls.append(x) or normalize(x))
    monkeypatch.setattr(tok.automaton, "encode_all", lambda x: learned.extend(x) or encode_all(x))
    texts = [docs[x] or "" for x in sorted(docs)][:40]
    ids = tok.encode_all([x.encode() for x in texts])
    assert [list(array("I", x)) for x in ids] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(calls) <= 1 + sum(len(x.encode()) for x in texts) // tok.RUN_BYTES  # the library gets a run's pieces in one call
    assert len(learned) == len(set(learned))


def test_bpe_bounds(library, monkeypatch):
    for name, value in (("RUN_BYTES", 500), ("PIECE_BYTES", 50_000), ("WORD_BYTES", 50_000)):
        monkeypatch.setattr(Tokenizer, name, value)
    tok = Tokenizer(Q.VOCAB)
    texts = [" ".join(f"w{i}x{j}é" * 9 if j % 9 == 0 else f"an{i * j}ing" for j in range(300)) for i in range(12)]
    for text in texts + texts[:2]:
        assert list(array("I", tok.encode(text))) == library.encode(text, add_special_tokens=False).ids
        for kept, most in ((tok.pieces, tok.PIECE_BYTES), (tok.words, tok.WORD_BYTES)):
            assert sum(len(k) + len(v) + kept.ENTRY_BYTES for d in (kept.young, kept.old) for k, v in d.items()) <= most + 2 * 500 * 200


def test_bpe_query(spark, docs, library):
    rows = Q.op1_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd(spark):
    out = bpe_encode(frame(spark, ODD), Q.VOCAB)
    rows = out.collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_tokens for r in rows}[1] == 0
    again = bpe_decode(out.select("doc_id", "token_ids", "decoded"), Q.VOCAB, out_col="again")
    assert again.where("again <> decoded").count() == 0
    assert bpe_encode(frame(spark, []), Q.VOCAB).count() == 0


# --- 2 ------------------------------------------------------------------------


def test_shards_query(spark, docs):
    rows = Q.op2_shards(spark, SF).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert max(sum(r.size for r in s) for s in by.values()) <= total / 24 + largest


def test_shards_even_with_one_text(spark):
    rows = [(i, "the same text of a large group") for i in range(3000)] + [(i, f"text {i} " * 4) for i in range(3000, 6000)] + [(7, "repeated")] * 2000
    placed = shard_documents(frame(spark, rows).repartition(3)).collect()
    sizes = Counter()
    for r in placed:
        sizes[r.shard] += r.size
    assert len(placed) == 8000 and max(sizes.values()) < 1.01 * min(sizes.values()) + 80


def test_shards_odd(spark, tmp_path):
    rows = shard_documents(frame(spark, ODD), keep=("text",)).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.size for r in rows}[1] == 8 and {r.doc_id: r.text for r in rows}[2] == ""
    assert shard_documents(frame(spark, [])).count() == 0
    write_shards(frame(spark, ODD).select("doc_id", "text"), str(tmp_path / "out"), 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


def test_locate():
    bh, bg = np.array([0, 5, 5, 9]), np.array([0, 0, 7, 0])
    assert locate(bh, bg, np.array([-1, 0, 5, 5, 5, 10]), np.array([3, 0, -1, 6, 7, 0])).tolist() == [0, 1, 1, 2, 3, 4]


def test_cuts_of_nothing(spark):
    assert len(find_cuts(spark.createDataFrame([], "h long, g long, size long"), 4).shard)


# --- 3 ------------------------------------------------------------------------


def area(score, y):
    """Area under the curve: how often a good document stands above a bad one."""
    good, bad = np.array([s for s, v in zip(score, y, strict=True) if v]), np.array([s for s, v in zip(score, y, strict=True) if not v])
    return float(((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad)))


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in Q.op3_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [x for x in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if zlib.crc32(str(x.doc_id).encode()) % 3 == 1]
    assert len(labels) > 50 and np.mean([rows[x.doc_id].kept == bool(x.quality) for x in labels]) > 0.9
    assert area([rows[x.doc_id].score for x in labels], [x.quality for x in labels]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_sites_decide_where_texts_say_little(spark):
    import random

    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    words = [word() for _ in range(60)]
    # texts are noise; hosts differ, paths within them too
    share = {("a", "x"): 0.95, ("a", "y"): 0.8, ("b", "x"): 0.2, ("b", "y"): 0.05}
    rows = [(i, " ".join(rnd.choice(words) for _ in range(20)), site[1], site[0], 0, int(rnd.random() < p)) for i, (site, p) in enumerate((list(share.items()) * 200)[:800])]
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(df, labels).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert area([got[r[0]].evidence for r in held], [r[5] for r in held]) < 0.7 < 0.8 < area([got[r[0]].score for r in held], [r[5] for r in held])
    means = {site: got[next(r[0] for r in held if (r[3], r[2]) == site)].path_mean for site in share}
    assert [k for k, _ in sorted(means.items(), key=lambda x: -x[1])] == list(share)


def test_posteriors_equal_brute_force(spark):
    import random

    rnd = random.Random(9)
    rows = []
    for h in range(12):
        base = rnd.random()
        rows += [(f"h{h}", f"p{rnd.randrange(3)}", 1.0 if rnd.random() < 0.5 else 0.1, base) for _ in range(rnd.choice((1, 3, 30)))]
    rows = [(h, p, n, n * float(rnd.random() < b)) for h, p, n, b in rows] + [("h0", "p0", 1.0, 1.0)] * 40  # repeated rows
    found, total = site_posteriors(spark.createDataFrame(rows, "host string, path string, n double, s double").repartition(3))
    want_total = sum(r[3] for r in rows) / sum(r[2] for r in rows)
    assert total == pytest.approx(want_total)

    def sums(keys):
        out = {}
        for r in rows:
            n, s = out.get(r[:keys], (0.0, 0.0))
            out[r[:keys]] = n + r[2], s + r[3]
        return out

    def strength(groups):
        g = [(n, s, p) for n, s, p in groups if n >= 2]
        between, within = sum(n * (s / n - p) ** 2 for n, s, p in g), sum(p * (1 - p) for _, _, p in g)
        excess = (between - within) / sum(n * p * (1 - p) for n, _, p in g)
        return min(1000.0, max(2.0, 1 / excess - 1)) if excess > 0 else 1000.0

    hosts, paths = sums(1), sums(2)
    above = strength([(n, s, want_total) for n, s in hosts.values()])
    prior = lambda h: (hosts[h,][1] + above * want_total) / (hosts[h,][0] + above)
    below = strength([(n, s, prior(k[0])) for k, (n, s) in paths.items()])
    want = []
    for h, p, n, s in rows:
        host = (max(0, hosts[h,][1] - s) + above * want_total) / (max(0, hosts[h,][0] - n) + above)
        want.append((h, p, n, s, host, (max(0, paths[h, p][1] - s) + below * host) / (max(0, paths[h, p][0] - n) + below)))
    got = sorted((r.host, r.path, r.n, r.s, r.host_mean, r.path_mean) for r in found.collect())
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


def test_quality_odd(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, None), (None, 1)], "doc_id long, quality int")
    assert score_quality(frame(spark, [*ODD, (None, "no id")]), labels).count() == len(ODD) + 1
    assert {r.evidence for r in score_quality(frame(spark, ODD), labels.limit(0)).collect()} == {0.5}
    assert score_quality(frame(spark, []), labels).count() == 0


# --- 4 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    sf = "/root/testdata/sf0.1"
    return fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), most=1500)


def test_toxicity_held_out(spark, model):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = [(r.score, labels[r.doc_id]) for r in score_toxicity(docs.where(docs.doc_id.isin(list(labels))), model).collect()]
    bad, good = [s for s, y in got if y], [s for s, y in got if not y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.88 and sum(s >= 0.7 for s in good) < 0.02 * len(good) and sum(s >= 0.7 for s in bad) > 0.5 * len(bad)


def test_toxicity_gaps(spark, model):
    texts = ["You are an idiot.", "you i d i o t man", "wor_thless", "a st-upid thing", "the trassh", "this is fine", "a b c d e f", ""]
    rows = score_toxicity(frame(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    assert [r.predicted for r in rows] == [1, 1, 1, 1, 1, 0, 0, 0] and rows[0].lang is None


def subsequences(word):
    """Weight of each subsequence of three letters: the decay to the power of the letters it spans, added up."""
    out = Counter()
    for i in range(len(word)):
        for j in range(i + 1, len(word)):
            for k in range(j + 1, len(word)):
                out[word[i] + word[j] + word[k]] += toxicity.DECAY ** (k - i + 1)
    return out


@given(st.lists(st.text(alphabet="^abcidot", max_size=12), min_size=1, max_size=6), st.lists(st.text(alphabet="^abcidot", min_size=3, max_size=10), min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_kernel_equals_brute_force(words, landmarks):
    """The normalised kernel of words, to its power; words of under three letters are like nothing."""
    got = toxicity.Kernel(landmarks)(words)
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            x, y = subsequences(w), subsequences(m)
            norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            want = (sum(v * y[f] for f, v in x.items()) / norm) ** toxicity.POWER if norm else 0.0
            assert abs(got[i, j] - want) < 1e-4


def test_toxicity_odd(spark, model):
    rows = score_toxicity(frame(spark, ODD), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = fit(frame(spark, ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none is None and {r.score for r in score_toxicity(frame(spark, ODD), none).collect()} == {0.0}
    assert score_toxicity(frame(spark, []), model).count() == 0


# --- 5 ------------------------------------------------------------------------


def sets_of(docs, size):
    out = {}
    for i, t in docs.items():
        w = re.findall(SPACED_WORD, (t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def components_of(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_neardup_equals_brute_force(spark):
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    docs, n = {}, 0
    for _ in range(12):  # families of edits, some of them chains
        base = [word() for _ in range(rnd.choice((12, 60, 200)))]
        for _ in range(rnd.choice((1, 4, 25))):
            docs[n] = " ".join(base)
            n += 1
            for _ in range(max(1, len(base) // 40)):
                base[rnd.randrange(len(base))] = word()
    docs |= {n: None, n + 1: "", n + 2: "Alone", n + 3: "alone", n + 4: "two words", n + 5: "Two  words"}
    for size in (2, 5):
        sets = sets_of(docs, size)
        want = components_of(sets)
        rows = near_duplicates(frame(spark, list(docs.items())).repartition(3), shingle=size).collect()
        assert {r.doc_id: r.component_id for r in rows} == want
        assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)


def test_neardup_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.neardup.BLOCK", 5)
    monkeypatch.setattr("lettermill.llm.neardup.COMBINED", 2)
    monkeypatch.setattr("lettermill.llm.neardup.LINKED", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        test_neardup_equals_brute_force(spark)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=30), st.integers(1, 7))
@settings(max_examples=300, deadline=None)
def test_runs_lose_nothing(rows, size):
    rows = sorted(rows)
    made = [neardup.pa.RecordBatch.from_arrays([neardup.pa.array([x[i] for x in rows[k : k + size]], neardup.pa.int64()) for i in (0, 1)] + [neardup.pa.nulls(len(rows[k : k + size]), neardup.pa.int64())], names=["key", "a", "b"]) for k in range(0, len(rows), size)]
    runs = list(neardup._runs(made))
    assert [(k, a) for key, own in runs for k, a in zip(key.tolist(), own.tolist(), strict=True)] == rows and all(len(key) for key, _ in runs)


def test_star_meets_the_least(spark, monkeypatch):
    """Each document of an entry is a candidate with the entry's least one, whatever runs the rows come in."""
    monkeypatch.setattr(neardup, "COMBINED", 2)
    monkeypatch.setattr(neardup, "LINKED", 3)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 16, (5, neardup.PLACES)).astype(np.uint16)
    signs = {}
    for i in range(40):
        sig = base[i % 5].copy()
        sig[rng.integers(0, neardup.PLACES, i % 9)] += 1
        signs[i] = sig
    reps = spark.createDataFrame([(i, s.tobytes()) for i, s in signs.items()], "id long, sig binary").repartition(4)
    entries = {}
    for i, s in signs.items():
        for e in neardup.index_entries(s[None])[0].tolist():
            entries.setdefault(e, []).append(i)
    want = {(i, min(ids)) for ids in entries.values() for i in ids if i != min(ids)}
    got = {(r.a, r.b) for r in neardup.star_candidates(reps).collect()}
    # within a task an entry's documents may meet the least of the task instead
    of = lambda pairs: components_of_pairs(pairs, signs)
    assert of(got) == of(want) and all(a > b for a, b in got)
    assert all(any(a in ids and b in ids for ids in entries.values()) for a, b in got)


def components_of_pairs(pairs, nodes):
    up = {i: i for i in nodes}
    while True:
        new = {i: min([up[i], *(up[b] for a, b in pairs if a == i), *(up[a] for a, b in pairs if b == i)]) for i in nodes}
        if new == up:
            return up
        up = new
    test_neardup_equals_brute_force(spark)


def test_neardup_query(spark, docs):
    rows = Q.op5_neardup(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_of(sets_of(docs, 2))


def test_neardup_odd(spark):
    rows = near_duplicates(frame(spark, [*ODD, (None, "no id")])).collect()
    assert len(rows) == len(ODD) + 1 and {r.doc_id: r.component_id for r in rows}[6] == 5
    assert near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (1, 2), (2, 1), (3, 3), (50, 1)] + [(i, 100) for i in range(101, 160)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 6 for i in range(6, 10)}, 1: 1, 2: 1, 50: 1, **{i: 100 for i in range(100, 160)}}


# --- 6 ------------------------------------------------------------------------


def hits_of(text, items, width=13):
    words = re.findall(ALNUM_WORD, (text or "").translate(LOWER))
    hit, ids = set(), set()
    for key, item in items:
        w = re.findall(ALNUM_WORD, (item or "").translate(LOWER))
        n = min(width, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(key))
    return len(words), len(hit), sorted(ids)


def test_contamination_query(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = Q.op6_decontaminate(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, h, ids = hits_of(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), h > 0 and 20 * h >= n)


def test_contamination_odd(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [(1, None), (2, ""), (3, f"x {passage.upper()}. y"), (4, passage[: len(passage) // 2]), (5, "short item"), (6, "A short, item is here"), (7, f"{passage} z {passage}"), (8, LONG), (8, LONG)]
    items = [(10, passage), (11, "Short item"), (12, None), (13, "..."), (14, passage), (15, "again and again the quick")]
    test = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 100):  # one block of items, and several
        monkeypatch.setattr("lettermill.llm.decontaminate.BLOCK_BYTES", size)
        own = texts if size > 100 else texts[:-1]
        for r in find_contamination(frame(spark, own), test).collect():
            n, h, ids = hits_of(dict(texts)[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.items) == (n, h, ids)
            if r.doc_id == 3:
                assert r.longest == 20 and r.spans[0]["from"] == 1 and r.contaminated
    assert find_contamination(frame(spark, texts), test.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert find_contamination(frame(spark, []), test).count() == 0


def test_longest_match_stays_in_one_item(spark):
    words = [f"w{chr(97 + i)}" for i in range(16)]
    items = spark.createDataFrame([(1, " ".join(words[:13])), (2, " ".join(words[1:14]))], "item_id long, text string")
    row = find_contamination(frame(spark, [(1, " ".join(words))]), items).first()
    assert (row.n_hit, row.longest, row.n_items) == (14, 13, 2)


def test_contamination_goes_by_row(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(20))
    texts = [(None, passage), (None, "clean words"), (None, None), (8, passage), (8, "other clean words")]
    test = spark.createDataFrame([(10, passage), (11, "never seen item")], "item_id long, text string")
    for size in (8 << 20, 100):
        monkeypatch.setattr("lettermill.llm.decontaminate.BLOCK_BYTES", size)
        rows = find_contamination(frame(spark, texts), test).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in rows) == [(0, 0, 0), (0, 2, 0), (0, 20, 20), (8, 3, 0), (8, 20, 20)]
        kept = decontaminate(frame(spark, texts), test)
        assert kept.columns == frame(spark, []).columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean words"), (8, "other clean words")]


# --- 7 ------------------------------------------------------------------------


def places_of(text):
    words = re.findall(ALNUM_WORD, (text or "").translate(LOWER))
    found = []
    for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(found)


def test_licenses_query(spark, docs):
    for r in Q.op7_licenses(spark, SF).collect():
        n, found = places_of(docs[r.doc_id])
        at, labels = [i for i, _ in found], sorted({x for _, x in found})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


def test_licenses_fuzzy(spark):
    texts = {1: "Under the GNU Genral Public Licence v2", 2: "MIT License. mit-license", 3: "submit license forms", 4: "cc, by CC BY cc by", 5: None, 6: "", 7: "apache\n\tLICENSE " * 5000, 8: "the quick brown fox"}
    rows = {r.doc_id: r for r in scan_licenses(frame(spark, list(texts.items()))).collect()}
    assert (rows[1].n_base, rows[1].labels) == (0, "gpl") and 0.8 < rows[1].score < 1 and rows[1].spans[0]["edits"] == 2 and rows[1].spans[0]["from"] == 2
    for i, t in texts.items():
        n, found = places_of(t)
        assert (rows[i].n_words, rows[i].n_base) == (n, len(found))
    assert rows[3].labels == rows[8].labels == "" and rows[8].score == 0


def within(phrase, edits, text, i):
    """Ends j, at words' ends, of pieces text[i:j] that are at most so many edits from the phrase."""
    row = list(range(len(phrase) + 1))
    for j in range(i, min(len(text), i + len(phrase) + edits)):
        new = [row[0] + 1]
        for k, c in enumerate(phrase):
            new.append(min(row[k] + (c != text[j]), row[k + 1] + 1, new[k] + 1))
        row = new
        if text[j + 1 : j + 2] == " " and row[-1] <= edits:
            yield j + 1, row[-1]


def test_fuzzy_licenses_equal_brute_force():
    """Wherever words are within the edits of a notice, a match covers or touches the place, and its edits and span are true."""
    import random

    rnd = random.Random(11)
    known = [n for n, _ in notices(tuple(licenses.BASE.items()), tuple(licenses.MORE.items()), licenses.LETTERS_AN_EDIT)]
    filler = "the of under a license by cc mit gnu public general apache and terms licence".split()
    hits = 0
    for _ in range(600):
        words = [rnd.choice(filler) for _ in range(rnd.randrange(6))]
        for _ in range(rnd.randrange(1, 4)):
            phrase = list(rnd.choice(known).phrase.decode().strip())
            for _ in range(rnd.randrange(5)):
                at = rnd.randrange(len(phrase))
                phrase[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "e", " ", "li"])
            words += "".join(phrase).split() + [rnd.choice(filler) for _ in range(rnd.randrange(3))]
        text = f" {' '.join(words)} "
        for notice in known:
            phrase = notice.phrase.decode().strip()
            want = [(i, j, e) for i in range(1, len(text)) if text[i - 1] == " " for j, e in within(phrase, notice.edits, text, i)]
            got = notice.matches(text.encode())
            hits += len(got)
            assert all(any(i < b and a < j for a, b, _ in got) for i, j, _ in want), (text, phrase, want, got)
            assert all(any((a, b) == (i, j) and n >= e for i, j, e in want) for a, b, n in got), (text, phrase, want, got)
            assert {(i, j) for i, j, e in want if e == 0} == {(a, b) for a, b, n in got if n == 0}
    assert hits > 500


# --- 8 ------------------------------------------------------------------------


def canon(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def check_prints(rows, texts):
    ids = sorted(texts, reverse=True)
    prints = {}
    for k, i in enumerate(ids):
        t, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == float(canon(edited) == canon(t)) and r.near_next == float(canon(after) == canon(t))
        assert prints.setdefault(canon(t), r.fingerprint) == r.fingerprint and prints.setdefault(canon(edited), r.edited_fingerprint) == r.edited_fingerprint
    assert len(set(prints.values())) == len(prints)


def test_fingerprints_query(spark, docs):
    check_prints({r.doc_id: r for r in Q.op8_fingerprints(spark, SF).collect()}, docs)


def test_fingerprints_odd(spark):
    texts = {1: None, 2: "", 30: "ﬁne  Straße X", 4000: "FINE strasse x", 5: "étude", 6: "Étude", 7: "😀😀😀😀", 8: LONG, 10**12: "x", 9: "x", 11: "x"}
    check_prints({r.doc_id: r for r in fingerprint_edits(frame(spark, list(texts.items()))).collect()}, texts)
    check_prints({r.doc_id: r for r in fingerprint_edits(frame(spark, [(3, "alone here")])).collect()}, {3: "alone here"})
    assert fingerprint_edits(frame(spark, [])).count() == 0
    assert fingerprint_edits(frame(spark, ODD)).count() == len(ODD)
    assert {r.copies for r in fingerprint_documents(frame(spark, ODD)).where("doc_id in (5, 6)").collect()} == {2}


def test_fingerprints_of_any_ids(spark, monkeypatch):
    monkeypatch.setattr("lettermill.llm.fingerprints.STRETCH_ROWS", 40)
    monkeypatch.setattr("lettermill.llm.fingerprints.BROADCAST_BYTES", 0)
    texts = {i * (7 if i % 2 else 1): f"text of {i % 50} " * (i % 9) for i in range(1500)} | {-(1 << 62): "low", (1 << 62): "high", (1 << 63) - 1: "text of 1 "}
    check_prints({r.doc_id: r for r in fingerprint_edits(frame(spark, list(texts.items()))).collect()}, texts)
    # rows without an id come last, equal ids in the order of their texts' hashes: whoever is next, each row has its own result
    rows = [(None, f"no id {i} ab") for i in range(300)] + [(5, f"same id {i} abc") for i in range(300)] + [(5, "same id and text")] * 3 + [(6, None)]
    got = fingerprint_edits(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got}) == len({t for _, t in rows})


def test_stretches_are_even(spark, monkeypatch):
    from lettermill.llm.fingerprints import _stretches

    monkeypatch.setattr("lettermill.llm.fingerprints.STRETCH_ROWS", 500)
    from pyspark.sql import functions as F

    ids = spark.range(1, 20_001).unionByName(spark.range(1 << 62, (1 << 62) + 1)).unionByName(spark.range(5000).select(F.lit(None).cast("long").alias("id")))
    rows = ids.select("id", F.xxhash64(F.monotonically_increasing_id()).alias("x"))
    rows = rows.withColumn("part", _stretches(rows))
    counts = [r.asDict() for r in rows.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("part").collect()]
    assert max(c["n"] for c in counts) < 1500 and sum(c["n"] for c in counts) == 25_001
    some = [c for c in counts if c["lo"] is not None]
    assert all(a["hi"] <= b["lo"] for a, b in zip(some, some[1:], strict=False))


def test_fingerprint_collisions(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr("lettermill.llm.fingerprints.wide_hash", lambda c: [F.lit(1).cast("long") + F.char_length(c), F.lit(2).cast("long")])
    texts = {i: t for i, t in enumerate(["abc", "abd", "ABC", "xyz", "abc", "abcdef"])}
    check_prints({r.doc_id: r for r in fingerprint_edits(frame(spark, list(texts.items()))).collect()}, texts)


# --- 9 ------------------------------------------------------------------------


def test_lines(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    alone = [" ".join(f"{x}{chr(97 + i) * 3}" for x in "some words that nobody else in any other place has".split()) for i in range(8)]
    texts = {
        1: f"{alone[0]}\n{passage}\n{alone[1]}", 2: f"{passage}\n{alone[2]}", 3: f"  {passage} \n{passage}",
        4: "user 12 logged in from host 7 at the main site\n" + alone[3], 5: "user 99 logged in from host 8 at the main site\n" + alone[4],
        6: "dear customer alice your order has been sent today with care from us", 7: "dear customer bob your order has been sent today with care from us",
        9: "dear customer carol your order has been sent today with care from us", 10: "Yes.\nNo.", 11: "Yes.\nNo.", 12: None, 13: "", 14: alone[5] + "\n\n",
    }
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, list(texts.items()))).collect()}
    assert got[1].text == texts[1] and got[2].text == alone[2] and got[3].text == "" and got[3].n_dropped == 2
    assert got[4].text == texts[4] and got[5].text == alone[4] and got[6].text == texts[6] and got[7].text == ""
    assert got[10].text == got[11].text == "Yes.\nNo." and got[12].text is None and got[13].text == "" and got[14].text == texts[14] and got[14].n_lines == 3
    assert got[1].score == "y"


def test_lines_odd(spark):
    rows = drop_recurring_lines(frame(spark, ODD)).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.text for r in rows}[6] == "" and {r.doc_id: r.text for r in rows}[5] != ""
    assert drop_recurring_lines(frame(spark, [])).count() == 0


def test_lines_query_drops_what_repeats(spark, docs):
    rows = {r.doc_id: r for r in Q.op9_lines(spark, SF).collect()}
    assert set(rows) == set(docs)
    holders = {}
    for i, t in docs.items():
        for line in set(t.split("\n")):
            holders.setdefault(line, set()).add(i)
    for line, ids in holders.items():
        if len(ids) > 1 and len(line.split()) > 7 and not re.search(r"\s\s|^\s|\s$|\d", line):
            assert {i for i in ids if line in rows[i].text.split("\n")} <= {min(ids)}


def test_short_lines_count_like_others(spark, docs):
    texts = [(1, "Yes.\nOne two three four\n\nown words of one"), (2, "Yes.\nOne two three four\n\nand words of another"), (3, None)]
    got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, texts), min_tokens=1).collect()}
    assert got[1].text == texts[0][1] and got[2].text == "\nand words of another" and got[2].n_dropped == 2 and got[3].text is None
    rows = {r.doc_id: r for r in Q.op9_lines(spark, SF).collect()}
    first = {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            first.setdefault(" ".join(line.split()), i)
    for i, r in rows.items():
        left = [" ".join(x.split()) for x in r.text.split("\n")]
        assert all(first[x] == i for x in left if x)


def test_templates_share_a_leaf(spark, monkeypatch):
    one = lambda x: f"dear customer {x} your order has been sent today with care from us"
    two = lambda x: f"dear customer {x} we could not take any money off your card us"
    # two templates of one size, lines that only join the leaf, and a short template
    made = [one("alice"), one("bob"), two("carol"), two("dora")] + ["dear customer " + " ".join(f"w{chr(97 + i)}{chr(97 + k)}x" for k in range(10)) + " us" for i in range(20)]
    made += ["Posted by Alice in city news", "Posted by Bob in city news"]
    assert len({(len(x.split()), *x.split()[:2], x.split()[-1]) for x in made[:24]}) == 1
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, list(enumerate(made)))).collect()}
    assert {i for i, t in got.items() if not t} == {1, 3, 25}
    monkeypatch.setattr("lettermill.llm.lines.TOGETHER", 3)  # the leaf is brought down first
    monkeypatch.setattr("lettermill.llm.lines.BROADCAST_BYTES", 0)  # and joins shuffle
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, list(enumerate(made)))).collect()}
    assert {i for i, t in got.items() if not t} == {1, 3, 25}


def tree_by_hand(texts, min_docs=2):
    """What the tree drops, line by line; leaves are small."""
    field = re.compile(r"(?<![^ ])(?=[^ 0-9]*[0-9])[^ ]+")
    order = lambda w: int.from_bytes(xxhash.xxh64(w.encode(), seed=42).digest(), "big", signed=True)
    lines = {i: [field.sub("<*>", " ".join(re.split(r"[ \t\n\x0b\f\r]+", x)).strip(" ")) for x in t.split("\n")] for i, t in texts.items()}
    leaves = {}
    for w in {w for ws in lines.values() for w in ws if w}:
        leaves.setdefault((len(w.split(" ")), *w.split(" ")[:2]), []).append(w)
    template = {}
    for ws in leaves.values():
        leads = []
        for w in sorted(ws, key=order):
            x = w.split(" ")
            agree = [y for y in leads if sum(a == b for a, b in zip(x, y.split(" "), strict=True)) >= max(math.ceil(len(x) * 0.6), 3)]
            if not agree:
                leads.append(w)
            template[w] = (agree or [w])[0]
    docs = {}
    for i, ws in lines.items():
        for w in filter(None, ws):
            docs.setdefault(template[w], set()).add(i)
    gone = {t: min(d) for t, d in docs.items() if len(d) >= min_docs}
    return {i: "\n".join(x for x, w in zip(texts[i].split("\n"), ws, strict=True) if not w or gone.get(template[w], i) == i) for i, ws in lines.items()}


@pytest.mark.parametrize("small", [False, True])
def test_lines_equal_brute_force(spark, docs, monkeypatch, small):
    if small:
        monkeypatch.setattr("lettermill.llm.lines.BROADCAST_BYTES", 0)
    texts = {i: t for i, t in docs.items() if t is not None}
    for least in (2, 3):
        got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, list(texts.items())), min_docs=least, min_tokens=1).collect()}
        assert got == tree_by_hand(texts, least)


@pytest.mark.parametrize("templates, copies, unique, together", [(60, 3, 200, 64), (200, 2, 400, 8), (150, 20, 4000, 64)])
def test_lines_of_a_large_leaf_equal_brute_force(spark, monkeypatch, templates, copies, unique, together):
    """Templates of seven fixed places in ten, in one leaf, whose fields share words with other templates."""
    monkeypatch.setattr("lettermill.llm.lines.TOGETHER", together)
    if copies == 2:
        monkeypatch.setattr("lettermill.llm.lines.BROADCAST_BYTES", 0)
    rnd = np.random.default_rng(1)
    known = ["".join(rnd.choice(list("abcdefghij"), 5)) for _ in range(400)]
    word = lambda: known[rnd.integers(len(known))]
    lines = [[word() for _ in range(10)] for _ in range(unique)]
    for _ in range(templates):
        base, fixed = [word() for _ in range(10)], set(rnd.permutation(10)[:7].tolist())
        lines += [[b if k in fixed else word() for k, b in enumerate(base)] for _ in range(copies)]
    texts = {int(i): "dear reader " + " ".join(lines[j]) for i, j in enumerate(rnd.permutation(len(lines)))}
    got = {r.doc_id: r.text for r in drop_recurring_lines(frame(spark, list(texts.items())), min_tokens=1).collect()}
    assert got == tree_by_hand(texts) and sum(t == "" for t in got.values()) >= templates * (copies - 1)


def test_planted_templates_are_found(spark, monkeypatch):
    names = [f"{a}{b}" for a in ("al", "bo", "ca", "du", "ev") for b in ("ice", "bby", "rol", "ncan", "elyn", "ina", "ert", "ton")]
    forms = [lambda x: f"dear reader {x} has left a note on our front page", lambda x: f"dear reader we thank our good friend from far off {x}", lambda x: f"{x} wrote to us about the weather of last week", lambda x: f"please ask {x}"]
    own = [" ".join(f"own{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(12)) for i in range(160)]
    rows = [(40 * f + i, f"{own[40 * f + i]}\n{form(x)}") for f, form in enumerate(forms) for i, x in enumerate(names)]
    for together in (128, 8):
        monkeypatch.setattr("lettermill.llm.lines.TOGETHER", together)
        got = {r.doc_id: r for r in drop_recurring_lines(frame(spark, rows), min_tokens=1).collect()}
        assert all(r.text.split("\n")[0] == own[i] for i, r in got.items())  # nobody's own line goes
        # the first two forms share a leaf with each other's lines; a template whose first token varies can't share a leaf, nor one of too few places
        assert [sum(got[40 * f + i].n_dropped for i in range(40)) for f in range(4)] == [39, 39, 0, 0]


def test_lines_without_id_or_with_a_repeated_one(spark):
    line = "this line stands in many documents of the table"
    rows = [(None, f"{line}\nown words of the first without an id here"), (1, f"{line}\nunique sentence of the first row with this id"), (1, f"another unique sentence of this id\n{line}"), (2, line), (2, line), (None, line)]
    got = sorted((r.doc_id is None, r.doc_id, r.text) for r in drop_recurring_lines(frame(spark, rows)).collect())
    kept = [x for x in got if line in x[2]]
    assert len(got) == 6 and len(kept) == 1 and kept[0][1] == 1
    assert {x[2] for x in got} - {kept[0][2]} <= {"", "own words of the first without an id here", "unique sentence of the first row with this id", "another unique sentence of this id"}
    assert sum("unique sentence" in x[2] for x in got) == 2


# --- 10 -----------------------------------------------------------------------


def alone(html):
    lines = page_lines(html)
    return Page("k", [kind for kind, _ in lines], [text for _, text in lines], frozenset()).text(None)


def test_html_lines():
    page = """<html><head><title>T</title></head><body class="home"><header>H</header><nav><ul><li>m</ul></nav><!-- <p>no</p> --><div class="ad x">ad</div>
    <article><h1>A &amp; b</h1><p>one<br>two &#8212; <b>th</b>ree<p>four &lt;x&gt;&nbsp;y<div class="comments"><p>c</p></div><script>"</p>"</script></article><p>after</p><footer>f</footer>"""
    assert alone(page) == "A & b\none two — three\nfour <x> y"
    assert page_lines("") == [] and page_lines("a < b <") == [(0, "a < b <")] and alone("<p>x<aside>y</aside>z") == "x\nz"


@pytest.mark.parametrize("pages", [5000, 3])
def test_page_differencing(spark, monkeypatch, pages):
    monkeypatch.setattr("lettermill.llm.html.STRETCH_PAGES", pages)
    page = lambda i, tag="div": f"<div>Site name</div><div>Home | About</div><{tag}><p>Own words of page {i} alone {i}</p><p>And more of page number {i}</p><div>Read our paper edition</div></{tag}><div>All the rest (c)</div>"
    want = lambda i: f"Own words of page {i} alone {i}\nAnd more of page number {i}"
    rows = [(i, f"http://h.example/a/{i}?q#x", page(i)) for i in range(12)] + [(50, "http://other.example/", page(50)), (51, None, None), (52, "http://h.example/a/3", page(3)), (53, "", ""), (None, "http://h.example/a/20", page(20))]
    # a template of most of the text, many copies of a page at one URL, and marked articles with a notice inside
    rows += [(100 + i, f"http://m.example/n/{i}", page(i, "article")) for i in range(9)] + [(200 + i, "http://h.example/a/7", page(7)) for i in range(30)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract_text(df.repartition(3)).collect()}
    assert len(got) == len(rows) and got[50].text.startswith("Site name") and got[51].text == got[53].text == "" and got[5].n_chars == len(got[5].text)
    assert [got[i].text for i in (*range(12), 52, None)] == [want(i) for i in (*range(12), 3, 20)]
    assert {got[200 + i].text for i in range(30)} == {want(7)} and [got[100 + i].text for i in range(9)] == [want(i) for i in range(9)]
    assert extract_text(df.limit(0)).count() == 0


def differenced_by_hand(pages):
    """Each page's text: the nearest page of the host, in the order of URLs, that is no copy; no two pages are copies that stand together."""
    out, hosts = {}, {}
    for i, url, html in sorted(pages, key=lambda p: url_key(p[1])):
        hosts.setdefault(url_key(url)[0], []).append((i, page_lines(html)))
    for rows in hosts.values():
        count = Counter(t for _, lines in rows for t in {t for _, t in lines})
        recurs = {t for t, n in count.items() if n >= max(3, len(rows) / 2)}
        for k, (i, lines) in enumerate(rows):
            texts = [t for _, t in lines]
            own = Counter(t for t in texts if t not in recurs)
            other = None
            for j in [*range(k - 1, max(-1, k - 3), -1), *range(k + 1, min(len(rows), k + 17))]:
                both = own & Counter(t for _, t in rows[j][1])
                if sum(len(t) * c for t, c in both.items()) <= sum(len(t) * c for t, c in own.items()) / 2:
                    other = [t for _, t in rows[j][1]]
                    break
            shared = set(common(texts, other)) if other is not None else {n for n, t in enumerate(texts) if t in recurs}
            marked = any(kind == MAIN for kind, _ in lines)
            out[i] = "\n".join(t for n, (kind, t) in enumerate(lines) if (kind == MAIN or not marked) and (n not in shared or kind == MAIN and t not in recurs))
    return out


def test_html_equals_brute_force(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for change in (lambda h: h, lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>")):
        given = [(i, u, change(h)) for i, u, h in pages]
        got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
        want = differenced_by_hand(given)
        assert sum(got[i] == want[i] for i in want) == len(want) == len(got)


def test_line_hash_is_signed():
    assert all(-(1 << 63) <= line_hash(str(i)) < 1 << 63 for i in range(50))


def test_common_is_longest():
    import random

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = common(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[i] in it for i in got)


def test_html_query(spark):
    import html

    for p in spark.read.parquet(f"{SF}/pages.parquet").join(Q.op10_html(spark, SF).drop("url"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", p.html, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert p.text == "\n".join(filter(None, blocks)) and p.n_chars == len(p.text)


# --- the pipeline -------------------------------------------------------------


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= before.count(), name
    assert docs.count() > 0.6 * 200
    left = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(components_of(sets_of({i: t for i, t in left.items() if t}, 5)).values())) == len([t for t in left.values() if t])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(not (h and 20 * h >= n) for n, h, _ in (hits_of(t, items) for t in left.values()))
    tokens = corpus_pipeline.encode(spark, docs, SF).collect()
    assert {r.doc_id for r in tokens} == set(left) and all(math.isfinite(r.n_tokens) for r in tokens)


def test_pipeline_as_a_whole(spark, tmp_path, monkeypatch):
    """run() gives what the stages give one after the other, and what stages stored on their way is gone."""
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: f"file://{tmp_path}/out")
    monkeypatch.setattr("lettermill.llm.common.shared_dir", lambda spark: f"file://{tmp_path}/way")
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert not list((tmp_path / "way").glob("*"))
    assert sorted(x.name.split("-")[1] for x in (tmp_path / "out").iterdir()) == sorted(name for name, _ in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted(rows) == sorted(docs.select("doc_id", "n_tokens", "ids_sha256").collect()) and rows
