"""Nearest neighbours by an inverted multi-index.

Vectors get one more component, sqrt(M^2 - |x|^2), so that the largest inner product is the least distance.
Each half is quantised by its own centroids; a row's entry is the pair of its centroids. A query goes through pairs by
summed squared distance with a heap: first until the cells passed hold a few times k entries, whose exact
scores bound the k-th distance; then on, until a pair's entries can hardly be nearer than that bound. Entries of the cells
passed are scored exactly. Cells are dealt to shards of bounded size, large cells to several; a query goes to the shards
that have cells of its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, released, stored
from lettermill.llm.vectors import CELLS, best, finite, matrix, meet, ranks

#: Rows that centroids are fitted on, rounds of fitting, entries of a shard about.
SAMPLE, ROUNDS, SHARD = 8192, 8, 16384


def usable_vectors(rows: DataFrame) -> DataFrame:
    """(id, v, norm): one row for each usable vec_id, components as doubles."""
    rows = rows.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("norm", norm)


def centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from rows chosen by a fixed seed."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x if len(x) else np.zeros((1, x.shape[1]))
    at = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _squares(x, at).argmin(1)
        total = np.zeros_like(at)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        at = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], at)
    return at


def _squares(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (at * at).sum(1) - 2 * (x @ at.T), 0)


class Index:
    """Centroids of both halves; vectors are scaled to at most length 1, with the further component in the second half."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.dim, self.longest = sample.shape[1], longest
        self.cut = (self.dim + 1) // 2
        one, two = self.halves(sample, query=False)
        self.one, self.two = centroids(one, k, 1), centroids(two, k, 2)

    def halves(self, v: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        v = v / self.longest
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(1 - (v * v).sum(1), 0))
        return v[:, : self.cut], np.concatenate([v[:, self.cut :], more[:, None]], axis=1)

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell of each row and the squared residuals of its halves."""
        one, two = (_squares(h, c) for h, c in zip(self.halves(v, False), (self.one, self.two), strict=True))
        a, b = one.argmin(1), two.argmin(1)
        at = np.arange(len(v))
        return a * len(self.two) + b, one[at, a], two[at, b]

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = self.halves(v, True)
        return _squares(one, self.one), _squares(two, self.two)


def pairs(one: np.ndarray, two: np.ndarray):
    """(sum, i, j) of two lists, by sum: a heap with one pair for each row of the first list that has been reached."""
    a, b = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    x, y = one[a].tolist(), two[b].tolist()
    heap = [(x[0] + y[0], 0, 0)]
    while heap:
        total, i, j = heap[0]
        if j + 1 < len(y):
            heapq.heapreplace(heap, (x[i] + y[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        yield total, a[i], b[j]


class Cells:
    """What queries have to know of the cells: entries, mean residuals of both halves, and shards."""

    def __init__(self, index: Index, table: list):
        ka, kb = len(index.one), len(index.two)
        self.index, self.n = index, np.zeros(ka * kb, np.int64)
        self.first, self.parts = np.zeros(ka * kb, np.int64), np.ones(ka * kb, np.int64)
        left, right = np.zeros((ka, 2)), np.zeros((kb, 2))
        shard = filled = 0
        for cell, n, one, two in sorted(table):
            self.n[cell] = n
            left[cell // kb] += one, n
            right[cell % kb] += two, n
            if filled and filled + n > SHARD:
                shard, filled = shard + 1, 0
            self.first[cell], self.parts[cell] = shard, max(1, -(-n // SHARD))
            filled += n
            if self.parts[cell] > 1:
                shard, filled = shard + self.parts[cell], 0
        self.rest = left[:, 0] / np.maximum(left[:, 1], 1), right[:, 0] / np.maximum(right[:, 1], 1)

    def passed(self, one: np.ndarray, two: np.ndarray, enough: int, bound: float | None, width: float) -> list[int]:
        """Cells that a query goes through, given its squared distances from the centroids.

        Without a bound, until they hold ``enough`` entries; with one, until no pair's entries can be nearer: a
        pair's squared distances have the mean of the sum plus residuals, and a deviation that follows from both.
        """
        kb = len(two)
        (ra, rb), h = self.rest, (self.index.cut, self.index.dim + 1 - self.index.cut)
        va, vb = 4 * one * ra / h[0], 4 * two * rb / max(h[1], 1)
        margin = width * float(np.sqrt(va.max() + vb.max()))
        n, out, held = self.n, [], 0
        va, vb = va.tolist(), vb.tolist()
        for total, i, j in pairs(one + ra, two + rb):
            cell = i * kb + j
            if bound is None:
                if held >= enough:
                    break
            elif total - margin > bound:
                break
            elif total - width * (va[i] + vb[j]) ** 0.5 > bound:
                continue
            if n[cell]:
                out.append(cell)
                held += int(n[cell])
        return out

    def shards(self, cells: list[int]) -> list[int]:
        return sorted({s for c in cells for s in range(self.first[c], self.first[c] + self.parts[c])})


def _first(rows: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(rows: DataFrame, every: int = 20, k: int = 20, cells: int = 64, enough: int = 10, width: float = 3.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose vec_id is divisible by ``every``.

    ``cells`` centroids a half; the first pass goes on for ``enough`` * k entries; ``width`` deviations are allowed for in the
    second: wider passes more cells and finds more. Rows without vec_id or vector, with a null or non-finite
    component, or all zero, take no part. Rows that repeat a vec_id count once, the least vector. Of vectors of different lengths,
    the shorter one's missing components count as 0. Equal scores: smaller vec_id first. No queries: no result.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = stored(usable_vectors(rows), "vectors")
    longest, dim = rows.agg(F.max("norm"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    # lengths whose squares have no double are scaled by the largest component
    longest = (longest or 1.0) ** 0.5 if longest != float("inf") else rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] * dim**0.5
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    index = Index(matrix(sample["v"], dim), longest or 1.0, cells)

    def place(batches):
        for b in batches:
            cell, one, two = index.cells(matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "v": b.column("v"), "cell": pa.array(cell, pa.int32()), "one": pa.array(one), "two": pa.array(two)})

    entries = stored(rows.select("id", "v").mapInArrow(released(place), "id long, v array<double>, cell int, one double, two double"), "entries")
    known = Cells(index, [tuple(r) for r in entries.groupBy("cell").agg(F.count("*"), F.sum("one"), F.sum("two")).collect()])
    where = spark.createDataFrame([(c, int(known.first[c]), int(known.parts[c])) for c in np.flatnonzero(known.n).tolist()], "cell int, first long, parts long")
    shard = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    held = stored(entries.join(F.broadcast(where), "cell").select(shard.alias("unit"), "id", "v", "cell"), "shards")  # at most a row a cell is broadcast
    size = len(known.n)

    def routes(bounded: bool):
        def run(batches):
            for b in batches:
                one, two = index.distances(matrix(b.column("q"), dim))
                bound = b.column("bound").to_pylist() if bounded else [None] * len(one)
                for i in range(len(one)):
                    before = known.passed(one[i], two[i], enough * k + 1, None, 0)
                    new = before
                    if bounded:
                        # a query that has found fewer than k goes on to the end
                        all_of = known.passed(one[i], two[i], 0, bound[i] if bound[i] is not None else np.inf, width)
                        new = sorted(set(all_of) - set(before))
                    bits = np.zeros(size, bool)
                    bits[new] = True
                    units = known.shards(new)
                    if units:
                        again = pa.array(np.full(len(units), i))
                        marks = pa.array([np.packbits(bits).tobytes()] * len(units), pa.binary())
                        yield pa.RecordBatch.from_pydict({"unit": pa.array(units, pa.int64()), "query": b.column("query").take(again), "q": b.column("q").take(again), "marks": marks})

        return released(run)

    def score(held, passing):
        out = []
        x, q = matrix(held["v"], dim), matrix(passing["q"], dim)
        ids, cell, query = (t.to_numpy() for t in (held["id"], held["cell"], passing["query"]))
        marks = np.unpackbits(np.frombuffer(b"".join(passing["marks"].to_pylist()), np.uint8).reshape(len(q), -1), axis=1)[:, :size].astype(bool)
        step = max(1, CELLS // max(len(x), 1))
        with np.errstate(all="ignore"):
            for i in range(0, len(q), step):
                part = slice(i, i + step)
                s = np.nan_to_num(q[part] @ x.T, nan=-np.finfo(float).max, neginf=-np.finfo(float).max)
                s = np.where(marks[part][:, cell] & (ids != query[part, None]), s, -np.inf)
                at, col = best(s, k, slack=1e-12 * longest**2)
                exact = np.zeros(len(at))
                for d in range(dim):  # in order, so that equal vectors score equally
                    exact += q[part][at, d] * x[col, d]
                exact = np.nan_to_num(exact, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                order = np.lexsort((ids[col], -exact, at))
                order = order[ranks(at[order]) < k]
                out.append(pa.table({"query_id": query[part][at[order]], "vec_id": ids[col[order]], "score": exact[order]}))
        return pa.concat_tables(out)

    route, schema = "unit long, query long, q array<double>, marks binary", "query_id long, vec_id long, score double"
    queries = stored(rows.where(F.col("id") % every == 0).select(F.col("id").alias("query"), F.col("v").alias("q"), "norm"), "queries")
    found = stored(_first(meet(held, queries.select("query", "q").mapInArrow(routes(False), route), score, schema), k), "near")
    kth = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
    bound = F.col("norm") / longest**2 + 1.0 - 2.0 * F.col("kth") / longest**2
    again = queries.join(kth, queries["query"] == kth["query_id"], "left").select("query", "q", bound.alias("bound"))
    more = meet(held, again.mapInArrow(routes(True), route), score, schema)
    return _first(found.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")
