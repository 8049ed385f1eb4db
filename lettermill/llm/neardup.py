"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, links confirmed on full sets.

A document's shingle set is sketched to 64 minima of 16 bits each. The similarity that counts makes
signatures that differ in about a fifth of the places; signatures that differ in at most ``REACH``
places are candidates. The 64 places are split in chunks: by pigeonhole two signatures within reach
differ by at most ``ERRORS`` places in some chunk, so each chunk is indexed once for every choice
of places left out, and the pairs that share an index entry include all pairs within reach.
Candidates are then confirmed or refuted on the whole sets.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import SPACED, Words, encoded, hubs, mixed, pieces, prepare, released, spread_join, stored
from lettermill.llm.components import connected_components

PLACES = 64
ERRORS = 2
#: Places of each chunk; together all places.
CHUNKS = tuple(np.array_split(np.arange(PLACES), 9))
#: Signatures that differ in at most so many places always share an entry.
REACH = len(CHUNKS) * (ERRORS + 1) - 1
#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 80


def _rng() -> np.random.Generator:
    return np.random.default_rng(20240229)


_FACTORS = _rng().integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other; and where each text's begin."""
    h, n = words.hash, np.diff(words.first)
    k = np.minimum(size, n)  # a text with fewer words is one shingle
    count = np.where(n > 0, n - k + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    begin = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    value = np.zeros(len(text), np.uint64)
    for i in range(size):
        use = i < k[text]
        value[use] = mixed(value[use] * np.uint64(0x9E3779B97F4A7C15) + h[begin[use] + i] + np.uint64(i + 1))
    value = mixed(value + k[text].astype(np.uint64))
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """PLACES minima of each non-empty set, 16 bits of each."""
    out = np.empty((len(first) - 1, PLACES), np.uint16)
    for j, factor in enumerate(_FACTORS):
        out[:, j] = (mixed(np.minimum.reduceat(mixed_by(value, factor), first[:-1])) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def mixed_by(value: np.ndarray, factor: np.uint64) -> np.ndarray:
    x = value * factor
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def sketch(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, set_hash, sig): size, hash and signature of each text's set; sig is null for empty sets."""

    def run(batches):
        for batch in batches:
            texts = encoded(batch.column(1))
            count, total, sig = [], [], []
            for a, b in pieces(texts):
                value, first = shingle_sets(Words(texts[a:b], SPACED), size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                rows: list = [None] * (b - a)
                sums = np.zeros((b - a, 2), np.uint64)
                if len(full):
                    starts = np.append(first[:-1][full], len(value))
                    found = signatures(value, starts)
                    sums[full, 0] = np.add.reduceat(mixed(value), starts[:-1])
                    sums[full, 1] = np.bitwise_xor.reduceat(mixed(value + np.uint64(77)), starts[:-1])
                    for i, row in zip(full.tolist(), found, strict=True):
                        rows[i] = row.tobytes()
                count.append(n)
                total.extend(x.tobytes() for x in sums)
                sig.extend(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(count) if count else [], pa.int64()), pa.array(total, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "set_hash", "sig"])

    return df.select(df[id_col], df[text_col]).mapInArrow(released(run), f"id {dict(df.dtypes)[id_col]}, n long, set_hash binary, sig binary")


def index_entries(sig: np.ndarray) -> np.ndarray:
    """The index entries of signatures, a row for each: a hash for each chunk and choice of places left out."""
    out = []
    for c, chunk in enumerate(CHUNKS):
        for kept in combinations(range(len(chunk)), len(chunk) - ERRORS):
            value = np.full(len(sig), c * 1000, np.uint64)
            for i in kept:  # the place counts too, so that entries with other places left out differ
                value = value * np.uint64(0x9E3779B97F4A7C15) + (sig[:, chunk[i]].astype(np.uint64) + np.uint64(1 + (i << 17)))
            out.append(mixed(value))
    return np.array(out).T


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, PLACES)


#: Documents whose entries a task combines in one go, and entries that it links in one go.
COMBINED = 2500
LINKED = 1 << 16


def _runs(batches):
    """Of batches (key, a, b): pairs as they come, as Arrow arrays (a, b); the rows without b, in order, as runs (keys, a) of LINKED rows or so."""
    keys, own, n = [], [], 0
    for batch in batches:
        b = batch.column(2)
        if b.null_count < len(b):
            there = b.is_valid()
            yield batch.column(1).filter(there), b.filter(there)
        free = b.is_null()
        keys.append(batch.column(0).filter(free).to_numpy())
        own.append(batch.column(1).filter(free).to_numpy())
        n += b.null_count
        if n >= LINKED:
            yield np.concatenate(keys), np.concatenate(own)
            keys, own, n = [], [], 0
    if n:
        yield np.concatenate(keys), np.concatenate(own)


def star_candidates(reps: DataFrame) -> DataFrame:
    """(a, b): within each index entry, every document with the entry's least one.

    Each task combines its own entries first: an entry leaves a task once, with its least document,
    and the others are paired with that on the spot. So no entry grows with its group in a shuffle.
    """

    def combine(batches):
        for batch in (b.slice(a, COMBINED) for b in batches for a in range(0, b.num_rows, COMBINED)):
            ids, entries = batch.column(0).to_numpy(), index_entries(_signs(batch.column(1)))
            key, own = entries.ravel(), np.repeat(ids, entries.shape[1])
            order = np.lexsort((own, key))
            key, own = key[order], own[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = own[np.flatnonzero(new)[np.cumsum(new) - 1]]
            pairs = np.unique(np.stack([own[~new], head[~new]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(own[new]), pa.nulls(int(new.sum()), pa.int64())], names=["key", "a", "b"])
            # pairs only pass through the exchange: anywhere will do
            yield pa.RecordBatch.from_arrays([pa.array(mixed(np.arange(len(pairs), dtype=np.uint64) + np.uint64(len(ids))).view(np.int64)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["key", "a", "b"])

    def link(batches):
        # sorted by key, then document: the first of a key is its least, and is carried over from one run of rows to the next
        last = least = None
        for key, ids in _runs(batches):
            if isinstance(key, pa.Array):
                yield pa.RecordBatch.from_arrays([key, ids], names=["a", "b"])
                continue
            new = np.append(key[0] != last if last is not None else True, key[1:] != key[:-1])
            heads = ids[new] if new[0] else np.append(least, ids[new])
            head = heads[np.cumsum(new) - int(new[0])]
            pairs = np.unique(np.stack([ids, head], 1)[ids != head], axis=0)
            last, least = key[-1], head[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    entries = reps.select("id", "sig").mapInArrow(released(combine), "key long, a long, b long")
    return entries.repartition("key").sortWithinPartitions("key", "a").mapInArrow(released(link), "a long, b long").distinct()


#: Bits of the map of a set that bounds how much two sets can share.
BITS = 2048
#: Documents of an index entry that are compared in one go.
BLOCK = 2000
_SLOTS = [(c, kept) for c, chunk in enumerate(CHUNKS) for kept in combinations(range(len(chunk)), len(chunk) - ERRORS)]


def _first_slots() -> list[np.ndarray]:
    """For each chunk, the first entry that two signatures share, by the places (as bits) in which they differ there; or -1."""
    out = []
    for c, chunk in enumerate(CHUNKS):
        table = np.full(1 << len(chunk), -1, np.int16)
        for slot in range(len(_SLOTS) - 1, -1, -1):
            if _SLOTS[slot][0] == c:
                keep = sum(1 << i for i in _SLOTS[slot][1])
                table[[m for m in range(len(table)) if not m & keep]] = slot
        out.append(table)
    return out


_FIRST = _first_slots()


def shared_first(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The first entry that each signature shares with another, -1 if none."""
    differ = sig != one
    out = np.full(len(sig), -1, np.int16)
    for chunk, table in zip(reversed(CHUNKS), reversed(_FIRST), strict=True):
        slot = table[differ[:, chunk] @ (1 << np.arange(len(chunk)))]
        out = np.where(slot >= 0, slot, out)
    return out


def bit_map(value: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(value >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def block_pairs(slot: int, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, bits: np.ndarray, percent: int) -> list[np.ndarray]:
    """Pairs of documents of one entry that may be linked and aren't connected: of different components,
    in this entry first, within reach, near in size, and with maps that allow enough in common."""
    names, where, counts = np.unique(comp, return_inverse=True, return_counts=True)
    main = where == counts.argmax()  # pairs within the largest component need no look
    out = []
    for i in np.flatnonzero(~main):
        at = np.flatnonzero((comp != comp[i]) & (main | (ids < ids[i])) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        at = at[((sig[at] != sig[i]).sum(1) <= REACH)]
        at = at[shared_first(sig[at], sig[i]) == slot]
        # what one map has and the other lacks is surely not shared
        less = np.bitwise_count(bits[i] & ~bits[at]).sum(1, dtype=np.int64)
        more = np.bitwise_count(bits[at] & ~bits[i]).sum(1, dtype=np.int64)
        both = np.minimum(n[i] - less, n[at] - more)
        at = at[100 * both >= percent * (n[i] + n[at] - both)]
        if len(at):
            out.append(np.stack([np.maximum(ids[at], ids[i]), np.minimum(ids[at], ids[i])], 1))
    return out


def rest_candidates(reps: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components that share an index entry and may be linked.

    Columns of reps: id, comp, n, sig, bits. An entry whose documents are all of one component makes
    nothing; the others are compared inside the task, large ones in blocks dealt over tasks, and only
    pairs whose sets can be similar enough leave it, each from the first entry they share.
    """
    slots = len(_SLOTS)

    def enter(batches):
        for batch in (b.slice(a, COMBINED) for b in batches for a in range(0, b.num_rows, COMBINED)):
            entries = index_entries(_signs(batch.column("sig")))
            who = pa.array(np.repeat(np.arange(batch.num_rows), slots))
            slot = pa.array(np.tile(np.arange(slots, dtype=np.int16), batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(entries.ravel().view(np.int64)), slot, batch.column("id").take(who), batch.column("comp").take(who)], names=["key", "slot", "id", "comp"])

    def compare(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                slot, ids, comp, n, sig, bits = (batch.column(c)[row] for c in ("slot", "ids", "comps", "ns", "sigs", "bitss"))
                ids, comp, n = (np.array(x.as_py(), np.int64) for x in (ids, comp, n))
                pairs = block_pairs(slot.as_py(), ids, comp, n, np.frombuffer(b"".join(sig.as_py()), np.uint16).reshape(-1, PLACES), np.frombuffer(b"".join(bits.as_py()), np.uint64).reshape(len(ids), -1), percent)
                if pairs:
                    found = np.unique(np.concatenate(pairs), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    entries = stored(reps.select("id", "comp", "sig").mapInArrow(released(enter), "key long, slot short, id long, comp long"), "entries")
    # documents of an entry's largest component need no look at each other: only the others meet all blocks
    counts = entries.groupBy("key", "comp").agg(F.count("*").alias("c"))
    open_ = counts.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("key", F.col("m.comp").alias("main"), blocks(F.col("m.c")).alias("mains"), blocks(F.col("all") - F.col("m.c")).alias("others"), "all")
    heavy = hubs(open_.select("key", F.col("all").alias("n")), "key", reps.count() * slots)
    rows = spread_join(entries, open_.drop("all"), "key", "id", heavy)
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    own, upto = F.when(F.col("comp") == F.col("main"), -1 - at("mains")).otherwise(at("others")), F.sequence(F.lit(0), F.col("others") - 1)
    # blocks of the largest component count down from -1: each meets every block of others, and these meet each other
    meets = F.when(F.col("own") < 0, upto).otherwise(F.concat(upto, F.transform(F.sequence(F.lit(1), F.col("mains")), lambda x: -x)))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(meets)).select("key", "slot", "id", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rows = rows.join(reps.select("id", "comp", "n", "sig", "bits"), "id")
    groups = rows.groupBy("key", "lo", "hi").agg(F.first("slot").alias("slot"), *(F.collect_list(c).alias(f"{c}s") for c in ("id", "comp", "n", "sig", "bits")))
    return groups.drop("key", "lo", "hi").mapInArrow(released(compare), "a long, b long").distinct()


def full_sets(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, set, bits): the whole shingle sets of the documents of pairs (a stored table), and their maps."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("w")).distinct(), "wanted")

    def sets(batches):
        for batch in batches:
            texts, out, maps = encoded(batch.column(1)), [], []
            for a, b in pieces(texts):
                value, first = shingle_sets(Words(texts[a:b], SPACED), size)
                for i in range(b - a):
                    out.append(value[first[i] : first[i + 1]].tobytes())
                    maps.append(bit_map(value[first[i] : first[i + 1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(maps, pa.binary())], names=["id", "set", "bits"])

    few = wanted.count() * 16 <= 32 << 20  # ids only: broadcast while small, else the texts are shuffled
    texts = docs.select(F.col(id_col).alias("w"), F.col(text_col).alias("t")).join(F.broadcast(wanted) if few else wanted, "w", "left_semi")
    return stored(texts.mapInArrow(released(sets), "id long, set binary, bits binary").dropDuplicates(["id"]), "sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b; a stored table) whose full shingle sets are similar enough."""

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                short, long_ = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long_, short)
                at[at == len(long_)] = 0
                both = int((long_[at] == short).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    total = pairs.count()
    heavy = [hubs(pairs.groupBy(k).agg(F.count("*").alias("n")), k, total) for k in ("a", "b")]
    left = spread_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a", "b", heavy[0])
    return spread_join(left, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b", "a", heavy[1]).select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """Classes of near duplicates, a row for each input row: id, n_shingles, component_id, kept.

    Words are what white space separates, A-Z as a-z; sets of distinct shingles of ``shingle``
    words, or the whole text as one where it is shorter; documents with similar sets are linked and
    component_id is the least id reachable. Null and empty texts have empty sets and are linked with
    nothing. Equal sets are taken together first, so copies cost nothing. Rows that repeat an id must
    repeat its text; rows without an id are linked with nothing. Ids are integers; an empty table gives an empty result; other columns are dropped.
    """
    prepare(df.sparkSession)
    given = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col))
    docs = stored(sketch(given, id_col, text_col, shingle), "sketches")
    full = docs.where("sig is not null and id is not null")
    classes = full.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("copies"))
    reps = stored(classes.select(F.col("rep").alias("id"), "set_hash", "sig", "n", "copies"), "classes")
    # first, documents of an entry with its least one
    pairs = stored(star_candidates(reps), "candidates")
    sets = full_sets(pairs, given, id_col, text_col, shingle)
    links = stored(confirmed(pairs, sets, percent), "links")
    comps = stored(connected_components(links), "components")
    # then what shares an entry and isn't connected yet
    open_ = reps.join(sets.select("id", "bits"), "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "n", "sig", "bits")
    rest = stored(rest_candidates(stored(open_, "open"), percent).join(pairs, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        comps = stored(connected_components(links.unionByName(confirmed(rest, sets, percent))), "components")
    named = reps.join(comps.withColumnRenamed("node", "id"), "id", "left").select("set_hash", F.coalesce("component", "id").alias("component_id"))
    # documents without a class (no words, no id) need no join; those of a class with many copies are joined in parts
    row = lambda component: (F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    classed = F.col("sig").isNotNull() & F.col("id").isNotNull()
    heavy = hubs(reps.select("set_hash", F.col("copies").alias("n")), "set_hash", docs.count())
    out = spread_join(docs.where(classed), named, "set_hash", "id", heavy).select(*row(F.col("component_id")))
    out = out.unionByName(docs.where(~classed).select(*row(F.col("id"))))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
