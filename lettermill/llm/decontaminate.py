"""Benchmark decontamination with suffix arrays of the training text.

Each piece of a task's documents (1 MB) is a shard: its words' suffixes are sorted, and every suffix of the test
items is looked up in it by binary search. Matches come back with place and length; documents are
never shuffled.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import ALNUM, Words, encoded, pieces, prepare, released, small, stored

WINDOW = 13
#: Test items are looked up in blocks of so many bytes; a block is what tasks get at once.
BLOCK_BYTES = 4 << 20
#: Places of windows in items that are compared at once.
AT_ONCE = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TestSuffixes:
    """The windows of a block of test items, as rows of word codes that sort like the words."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        texts = [(text or "").encode() for _, text in items]
        words = Words(texts, ALNUM)
        self.width, self.ids = width, [i for i, _ in items]
        self.vocab = np.unique(words.hash)
        code = np.searchsorted(self.vocab, words.hash).astype(np.int64) + 1
        rows, sizes, owner = [], [], []
        for k in range(len(items)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            n = min(width, b - a)
            for at in range(a, b - n + 1 if n else a):
                row = np.zeros(width + 1, np.int64)
                row[:n], row[width] = code[at : at + n], n
                rows.append(row)
                sizes.append(n)
                owner.append(k)
        # a window that several items have is looked up once; ``same`` lists its places in the items, which count on within an item
        every = np.array(rows, np.int64).reshape(-1, width + 1)
        once, which = np.unique(every, axis=0, return_inverse=True)
        self.rows, self.size, self.owner = once[:, :width], once[:, width], np.array(owner, np.int64)
        self.same = np.argsort(which.ravel(), kind="stable")
        self.begin = np.searchsorted(which.ravel()[self.same], np.arange(len(once) + 1))
        self.shortest = int(self.size.min()) if len(rows) else 0
        spelled = {int(c): words.text(at, at + 1) for at, c in enumerate(code)}
        known = [spelled[c] for c in range(1, len(self.vocab) + 1)]
        self.letters = np.frombuffer(b"".join(known), np.uint8)
        self.length = np.array([len(w) for w in known], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def places(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of several windows all its places in the items: (index of the window in the list, place)."""
        n = self.begin[window + 1] - self.begin[window]
        at = np.repeat(np.arange(len(window)), n)
        return at, self.same[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[window], n)]

    def differ(self, words: Words, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of the words at ``at``, which aren't the words that their codes stand for."""
        c, size = code[at] - 1, words.end[at] - words.start[at]
        other = size != self.length[c]
        at, c, size = at[~other], c[~other], size[~other]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        mine = _LOWER[np.frombuffer(words.data, np.uint8)[np.repeat(words.start[at], size) + step]]
        wrong = np.zeros(len(size), bool)
        wrong[np.repeat(np.arange(len(size)), size)[mine != self.letters[np.repeat(self.start[c], size) + step]]] = True
        other[~other] = wrong
        return other

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """The least key that begins with each window, and a key above all that do."""
        high = self.rows.copy()
        high[np.arange(self.width) >= self.size[:, None]] = 0xFFFFFFFF
        return _keys(self.rows), _keys(high)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that compare as the rows do."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    return wide.view(f"S{4 * rows.shape[1]}").ravel() if len(rows) else np.empty(0, f"S{4 * rows.shape[1]}")


class SuffixArray:
    """The sorted suffixes of a shard's words, to ``width`` words; ``place`` is the first word's index.

    Suffixes that can't begin with a test window, since a word before its end is in no test item,
    are left out.
    """

    def __init__(self, words: Words, test: TestSuffixes):
        at = np.searchsorted(test.vocab, words.hash)
        at[at == len(test.vocab)] = 0
        code = np.where(test.vocab[at] == words.hash, at + 1, 0) if len(test.vocab) else np.zeros(len(at), np.int64)
        n, width = len(code), test.width
        #: Word index at which the run of known words that a word is in ends, within its document.
        stop = np.where(code == 0, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1] if n else stop
        stop = np.minimum(stop, np.repeat(words.first[1:], np.diff(words.first)))
        self.code = code
        self.place = np.flatnonzero(stop - np.arange(n) >= max(1, test.shortest))
        reach = self.place[:, None] + np.arange(width)
        rows = np.where(reach < stop[self.place][:, None], code[np.minimum(reach, max(0, n - 1))], 0)
        keys = _keys(rows)
        order = np.argsort(keys, kind="stable")
        self.keys, self.place = keys[order], self.place[order]

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence."""
        a, b = np.searchsorted(self.keys, low, "left"), np.searchsorted(self.keys, high, "right")
        b = np.maximum(a, b)
        window = np.repeat(np.arange(len(a)), b - a)
        offset = np.arange(len(window)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        return window, self.place[np.repeat(a, b - a) + offset]


def _longest(window: np.ndarray, place: np.ndarray, test: TestSuffixes) -> int:
    """Words of the longest verbatim match: hits of consecutive windows of one item at consecutive places."""
    most, total = 0, np.cumsum(test.begin[window + 1] - test.begin[window])
    items = max(1, -(-int(total[-1]) // AT_ONCE))  # so many parts of the items, one after the other
    for part in range(items):
        at, w = test.places(window)
        own = test.owner[w] % items == part
        at, w = at[own], w[own]
        if len(w):
            p, size = place[at], test.size[window[at]]
            order = np.lexsort((p, p - w))
            w, p, size = w[order], p[order], size[order]
            new = np.ones(len(p), bool)
            new[1:] = (np.diff(p) != 1) | (np.diff(w) != 1) | (np.diff(test.owner[w]) != 0)
            run = np.arange(len(p)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            most = max(most, int((run + size).max()))
    return most


def _matches(test: TestSuffixes):
    """The Arrow function from (key, text) to the columns of MATCHES."""

    def run(batches):
        low, high = test.bounds()
        for batch in batches:
            texts = encoded(batch.column(1))
            out: list[tuple] = []
            for a, b in pieces(texts):
                words = Words(texts[a:b], ALNUM)
                array = SuffixArray(words, test)
                window, place = array.find(low, high) if len(test.rows) else (np.empty(0, np.int64),) * 2
                # hashes found them; the words themselves decide, each once
                cover = np.zeros(len(array.code) + 1, np.int64)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + test.size[window], -1)
                hit = np.flatnonzero(np.cumsum(cover)[:-1])
                wrong = np.zeros(len(cover), np.int64)
                wrong[hit[test.differ(words, hit, array.code)] + 1] = 1
                wrong = np.cumsum(wrong)
                sound = wrong[place + test.size[window]] == wrong[place]
                window, place = window[sound], place[sound]
                order = np.argsort(place, kind="stable")
                window, place = window[order], place[order]
                cut = np.searchsorted(place, words.first)
                for i in range(b - a):
                    w, p = window[cut[i] : cut[i + 1]], place[cut[i] : cut[i + 1]]
                    begins, ends = [], []
                    for x, y in zip((p - words.first[i]).tolist(), (p - words.first[i] + test.size[w]).tolist(), strict=True):
                        if begins and x <= ends[-1]:
                            ends[-1] = max(ends[-1], y)
                        else:
                            begins.append(x)
                            ends.append(y)
                    items = [str(test.ids[k]) for k in np.unique(test.owner[test.places(np.unique(w))[1]])]
                    out.append((int(words.first[i + 1] - words.first[i]), begins, ends, items, _longest(w, p, test) if len(w) else 0))
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["k", "n_words", "begins", "ends", "items", "longest"])

    return run


def _blocks(test: DataFrame, id_col: str, text_col: str):
    """Items in blocks of at most BLOCK_BYTES (or one item), a partition's items at a time on the driver."""
    block, size = [], 0
    for key, text in test.select(id_col, text_col).toLocalIterator():
        more = len((text or "").encode())
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((key, text))
        size += more
    yield block


def find_contamination(docs: DataFrame, test: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """Verbatim matches of test items in documents, a row for each document row.

    Columns: id, n_words, n_hit (words inside a match), n_items, items (array, sorted as strings),
    items_sha256, spans (array of from/to word indexes), longest (words of the longest match),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words). Null and empty texts have no words and are
    clean; an item without words matches nothing; repeated items count once for each id; an empty
    table of items leaves every document clean. With more than one block of items, documents are
    read once for each block and merged by a key of their rows: rows that repeat an id, or have
    none, keep results of their own. One block at a time is on the driver.
    """
    prepare(docs.sparkSession)
    blocks = _blocks(test, item_col, item_text)
    blocks = [x for _, x in zip(range(2), blocks, strict=False)], blocks
    several = len(blocks[0]) > 1
    blocks = chain(*blocks)
    if several and id_col != ROW:
        rows = _keyed(docs.select(id_col, text_col))
        found = _found(rows, blocks, several, ROW, text_col, width)
        return rows.select(ROW, id_col).join(found, ROW).drop(ROW)
    return _found(docs, blocks, several, id_col, text_col, width)


#: What one block of items finds in a document, and what all blocks do, behind the document's key.
MATCHES = "n_words long, begins array<long>, ends array<long>, items array<string>, longest long"
FOUND = "n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<from: long, to: long>>, contaminated boolean, longest long"
#: Column with the key of a document's row.
ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of their own, stored so that it stays the same."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "document-rows")


def _merged(batches):
    """From the columns of MATCHES to those of FOUND: spans that touch become one."""
    for batch in batches:
        n, begins, ends, items, longest = (batch.column(k).to_pylist() for k in range(1, 6))
        out: list[list] = [[] for _ in range(6)]
        for a, b, names in zip(begins, ends, items, strict=True):
            spans: list[dict] = []
            for x, y in sorted(zip(a, b, strict=True)):
                if spans and x <= spans[-1]["to"]:
                    spans[-1]["to"] = max(spans[-1]["to"], y)
                else:
                    spans.append({"from": x, "to": y})
            names = sorted(set(names))
            for column, value in zip(out, (sum(s["to"] - s["from"] for s in spans), len(names), names, hashlib.sha256(",".join(names).encode()).hexdigest(), spans), strict=False):
                column.append(value)
        out[5] = [h > 0 and 20 * h >= k for h, k in zip(out[0], n, strict=True)]
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), span, pa.bool_()), strict=True)), pa.array(longest, pa.int64())],
            names=["k", "n_words", "n_hit", "n_items", "items", "items_sha256", "spans", "contaminated", "longest"],
        )


def _found(docs: DataFrame, blocks, several: bool, id_col: str, text_col: str, width: int) -> DataFrame:
    key = dict(docs.dtypes)[id_col]
    texts = docs.select(docs[id_col], docs[text_col])
    if not several:
        match = _matches(TestSuffixes(next(blocks), width))
        # one function: two, one after the other, would take two Python workers for each task
        return texts.mapInArrow(released(lambda batches: _merged(match(batches))), f"k {key}, {FOUND}").withColumnRenamed("k", id_col)
    passes = (texts.mapInArrow(released(_matches(TestSuffixes(block, width))), f"k {key}, {MATCHES}") for block in blocks)
    every = stored(next(passes), "matches")
    for more in passes:  # later blocks have something to say of few documents
        every = every.unionByName(stored(more.where("longest > 0"), "matches"))
    found = every.groupBy("k").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"), F.flatten(F.collect_list("items")).alias("items"), F.max("longest").alias("longest"))
    return found.mapInArrow(released(_merged), f"k {key}, {FOUND}").withColumnRenamed("k", id_col)


def decontaminate(docs: DataFrame, test: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns, that aren't contaminated; null and repeated ids and rows are judged row by row."""
    rows = _keyed(docs)
    bad = stored(find_contamination(rows, test, **options | {"id_col": ROW}).where("contaminated").select(ROW), "contaminated")
    return rows.join(small(bad, 16), ROW, "left_anti").select(docs.columns)
