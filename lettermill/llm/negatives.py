"""Hard negatives: a kNN join over Voronoi cells.

The largest inner product becomes the least distance by one more component, sqrt(M^2 - |x|^2), with M the
longest vector's length. Every row goes to the cell of its nearest pivot. An anchor first meets rows of its own
cell; the k-th score found bounds how far it must look, and the distances of anchors to the pivots then bound,
for each group of anchors and each cell, between which distances from the pivot a row may serve the group.
Only such rows are replicated to it. Units of a group and a bucket of rows are joined exactly in one task each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, released, small, stored
from lettermill.llm.vectors import CELLS, best, finite, matrix, meet, ranks

#: Rows that pivots are chosen from; anchors a pivot, pivots at least and at most.
SAMPLE, ANCHORS_A_PIVOT, PIVOTS = 2048, 1024, (8, 256)
#: Anchors of a group, and rows of a unit, about.
GROUP, BUCKET = 8192, 16384
#: Squared lengths from here on leave no exact scores.
LONGEST = float(1 << 62)


def scaled_vectors(rows: DataFrame) -> DataFrame:
    """(id, label, v, norm): one row for each usable vec_id, ``v`` the components floor(256 x)."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    norm = F.aggregate(F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")), F.lit(0.0), lambda s, x: s + x * x)
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")).cast("long")
    rows = rows.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), v.alias("v"), norm.alias("norm")).where(F.col("norm") < LONGEST)
    # a row that repeats an id counts once: the least label and vector
    return rows.groupBy("id").agg(F.min(F.struct("label", "v", "norm")).alias("r")).select("id", "r.*")


def _scores(a: np.ndarray, b: np.ndarray, longest: float) -> np.ndarray:
    """Exact inner products of integers."""
    if longest < 1 << 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a @ b.T


class Pivots:
    """Pivots in augmented space, and distances to them."""

    def __init__(self, sample: np.ndarray, n: int, longest: float):
        self.longest, self.dim = longest, sample.shape[1]
        x = np.concatenate([sample, self._more(sample)], axis=1) if len(sample) else np.zeros((1, self.dim + 1))
        chosen, near = [0], None
        while len(chosen) < min(n, len(x)):  # farthest first
            d = ((x - x[chosen[-1]]) ** 2).sum(1)
            near = d if near is None else np.minimum(near, d)
            if near.max() <= 0:
                break
            chosen.append(int(near.argmax()))
        self.at = x[chosen]

    def _more(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (v * v).sum(1), 0))[:, None]

    def distances(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.concatenate([v, np.zeros((len(v), 1)) if query else self._more(v)], axis=1)
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (self.at * self.at).sum(1) - 2 * (x @ self.at.T), 0))

    def slack(self) -> float:
        """What rounding can move a distance by."""
        return 1e-6 * (1 + self.longest**0.5)


def _placed(rows: DataFrame, pivots: Pivots, query: bool) -> DataFrame:
    """With ``cell`` and distance ``far`` of the nearest pivot; queries have no further component."""

    def run(batches):
        for b in batches:
            d = pivots.distances(matrix(b.column("v"), pivots.dim), query)
            cell = d.argmin(1)
            yield b.append_column("cell", pa.array(cell, pa.int32())).append_column("far", pa.array(d[np.arange(len(d)), cell], pa.float64()))

    return rows.mapInArrow(released(run), f"{rows._jdf.schema().toDDL()}, cell int, far double")


def _grouped(anchors: DataFrame, *by: str) -> DataFrame:
    """Anchors with a number ``g`` for each group of one ``by``; large ones are parted."""
    sizes = stored(anchors.groupBy(*by).agg(F.count("*").alias("size")), "groups")
    parts = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("size") / GROUP)).cast("long")
    return anchors.join(small(sizes, 40), list(by)).withColumn("g", F.xxhash64(*by, parts)).drop("size")


def _bounds(anchors: DataFrame, pivots: Pivots, keep: list[str]) -> DataFrame:
    """(g, keep.., cell, low, high): between which distances from a cell's pivot a row may be of use to an anchor of g.

    An anchor needs rows whose distance from it is between ``near`` and ``reach``.
    """

    def run(batches):
        for b in batches:
            d = pivots.distances(matrix(b.column("v"), pivots.dim), query=True)
            near, reach = (b.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("near", "reach"))
            low, high = np.maximum(d - reach, near - d) - pivots.slack(), d + reach + pivots.slack()
            rows, p = d.shape
            again = np.repeat(np.arange(rows), p)
            out = {c: b.column(c).take(pa.array(again)) for c in ("g", *keep)}
            yield pa.RecordBatch.from_pydict(out | {"cell": pa.array(np.tile(np.arange(p), rows), pa.int32()), "low": pa.array(low.ravel()), "high": pa.array(high.ravel())})

    schema = ", ".join(["g long", *(f"{c} long" for c in keep), "cell int, low double, high double"])
    each = anchors.select("g", *keep, "v", "near", "reach").mapInArrow(released(run), schema)
    return each.groupBy("g", *keep, "cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <= high")


def _joined(rows: DataFrame, anchors: DataFrame, links: DataFrame, by: list[str], buckets: int, join, schema: str) -> DataFrame:
    """Rows replicated to the groups that ``links`` names, and the exact join of each group with each bucket."""
    links = small(stored(links, "links"), 48)
    serve = rows.join(links, by).where(F.col("far").between(F.col("low"), F.col("high")))
    bucket = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(buckets))
    held = serve.select(F.xxhash64("g", bucket).alias("unit"), "g", "id", "label", "v")
    every = anchors.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    keep = [c for c in ("positive", "positives", "worth") if c in anchors.columns]
    passing = every.select(F.xxhash64("g", F.col("bucket").cast("long")).alias("unit"), F.col("g").alias("to"), F.col("id").alias("anchor"), F.col("label").alias("own"), F.col("v").alias("q"), *keep)
    return meet(held, passing, join, schema)


def _blocks(held, passing, dim: int, longest: float):
    """Anchors by runs: their slice, exact scores, and whether a row is of their group, and of their label."""
    kind = np.float64 if longest < 1 << 53 else np.int64
    x, q = matrix(held["v"], dim, kind), matrix(passing["q"], dim, kind)
    ids, labels, groups = (held[c].to_numpy() for c in ("id", "label", "g"))
    own, anchor, to = (passing[c].to_numpy() for c in ("own", "anchor", "to"))
    step = max(1, CELLS // max(len(x), 1))
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        fits = groups == to[part, None]  # units are hashes: two may share one
        yield part, _scores(q[part], x, longest).astype(np.float64 if kind is np.float64 else np.int64), fits, labels == own[part, None], ids, anchor[part]


def _ordered(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, cols: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k of each row, by score, then id."""
    order = np.lexsort((ids[cols], -score[rows, cols], rows))
    order = order[ranks(rows[order]) < k]
    return rows[order], cols[order]


def _masked(score: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """Scores for choosing; integers beyond 53 bits keep their order but for near ties, which ``best`` gets by its slack."""
    return np.where(fits, score.astype(np.float64), -np.inf)


def _slack(longest: float) -> float:
    return 0.0 if longest < 1 << 53 else longest * 2.0**-50


def _first(rows: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), name))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5) -> DataFrame:
    """For each anchor (vec_id divisible by ``every``) and each of its first positives, the first negatives that score
    80 to 100 % of the positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Exact. Rows without vec_id, label or vector, with a null or non-finite component, or of a squared length (components
    floor(256 x)) of 2^62 or more, take no part. Rows that repeat a vec_id count once, the least label and vector. Of vectors of different
    lengths, the shorter one's missing components count as 0. Equal scores: smaller vec_id first. No anchors: no result.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = stored(scaled_vectors(rows), "vectors")
    n, longest, dim = rows.agg(F.count("*"), F.coalesce(F.max("norm"), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    is_anchor = F.col("id") % every == 0
    count = rows.where(is_anchor).count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    low, high = PIVOTS
    pivots = Pivots(matrix(sample["v"], dim), min(max(low, -(-count // ANCHORS_A_PIVOT)), high), longest)
    buckets = max(1, -(-n // BUCKET))
    cells = stored(_placed(rows, pivots, query=False), "cells")
    anchors = stored(_placed(rows.where(is_anchor), pivots, query=True), "anchors")

    def same_label(held, passing):
        out = []
        for _, score, fits, same, ids, anchor in _blocks(held, passing, dim, longest):
            at, col = best(_masked(score, fits & same & (ids != anchor[:, None])), positives, _slack(longest))
            at, col = _ordered(score, ids, at, col, positives)
            out.append(pa.table({"anchor": anchor[at], "positive": ids[col], "score": score[at, col].astype(np.int64)}))
        return pa.concat_tables(out)

    schema = "anchor long, positive long, score long"
    inside = _grouped(anchors, "label", "cell")
    home = inside.select("g", "label", "cell").distinct().select("g", "label", "cell", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))
    near = stored(_joined(cells, inside, home, ["label", "cell"], buckets, same_label, schema), "home")
    # the k-th score found in the own cell bounds the distance of the others
    kth = _first(near, ["anchor"], "score", "positive", positives).groupBy("anchor").agg(F.when(F.count("*") == positives, F.min("score")).alias("kth"))
    reach = F.when(F.col("kth").isNull(), float("inf")).otherwise(F.sqrt(F.greatest(F.col("norm") + longest - 2.0 * F.col("kth"), F.lit(0.0))))
    far = inside.join(kth, inside["id"] == kth["anchor"], "left").withColumn("reach", reach).withColumn("near", F.lit(0.0))
    # rows of the own cell have been met
    away = _bounds(far, pivots, ["label"]).join(home.select("g", "label", "cell"), ["g", "label", "cell"], "left_anti")
    rest = _joined(cells, inside, away, ["label", "cell"], buckets, same_label, schema)
    found = stored(_first(near.unionByName(rest), ["anchor"], "score", "positive", positives).drop("rank"), "positives")

    def in_window(held, passing):
        out = []
        worth = passing["worth"].to_pylist()
        for part, score, fits, same, ids, anchor in _blocks(held, passing, dim, longest):
            goals = worth[part]
            for k in range(positives):
                goal = np.array([w[k] if k < len(w) else -1 for w in goals], score.dtype)
                # 80 p <= 100 s without a product that overflows: 4 (p - s) <= s
                fit = fits & ~same & (score <= goal[:, None]) & (score >= 0) & (goal[:, None] - score <= score // 4)
                at, col = best(_masked(score, fit), negatives, _slack(longest))
                at, col = _ordered(score, ids, at, col, negatives)
                out.append(pa.table({"anchor": anchor[at], "goal": goal[at].astype(np.int64), "negative": ids[col], "score": score[at, col].astype(np.int64)}))
        return pa.concat_tables(out)

    goals = found.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("worth"))
    wanted = anchors.join(goals, anchors["id"] == goals["anchor"]).drop("anchor")
    away = F.col("norm") + longest
    wanted = wanted.withColumn("near", F.sqrt(F.greatest(away - 2.0 * F.col("worth")[0], F.lit(0.0)))).withColumn("reach", F.sqrt(F.greatest(away - 1.6 * F.element_at("worth", -1), F.lit(0.0))))
    wanted = stored(_grouped(wanted, "cell"), "wanted")
    hard = _joined(cells, wanted, _bounds(wanted, pivots, []), ["cell"], buckets, in_window, "anchor long, goal long, negative long, score long")
    hard = _first(hard, ["anchor", "goal"], "score", "negative", negatives)
    return hard.join(found.withColumnRenamed("score", "goal"), ["anchor", "goal"]).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"),
    )
