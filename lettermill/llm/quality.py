"""Document quality by hierarchical empirical Bayes.

A classifier on the words and letter triples of a text gives each document evidence of its own. What
a site has shown is a posterior on two levels: a path's within its host's, a host's within the
corpus's. A labelled document speaks for its site by its label, any other by its evidence with less
weight, and no document speaks for itself. Each level is a Beta posterior whose prior is the level
above, with as much weight as the levels below vary little; sparse sites shrink to their host, sparse
hosts to the whole. All counts are grouped aggregates over every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import ALNUM, Words, encoded, mixed, pieces, prepare, released, small, stored

#: At most so many labelled documents are taken to fit, those with the least hash of the id.
TRAIN_DOCS = 20_000
#: Words, and letter triples, are told apart by so many bits of their hashes.
BITS = 15
#: Parts of the labelled documents; each is judged by a classifier of the others when weights are fitted.
FOLDS = 5
#: What an unlabelled document counts for its site, against 1 of a labelled one.
SOFT = 0.1
#: Keep from this probability of good quality on.
THRESHOLD = 0.5
#: Bounds of the weight of a prior, in documents.
LEAST, MOST = 2.0, 1000.0
#: No site, as a host or path of its own.
NONE = "\x00"


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature) of the different words and letter triples of each text; and the share of each text's pairs of words that are repeats."""
    words = Words(texts, ALNUM)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.first))
    word = (words.hash >> np.uint64(64 - BITS)).astype(np.int64)
    raw = np.frombuffer(words.data, np.uint8).astype(np.uint64)
    size = np.array([len(t) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), size)
    inside = text[:-2] == text[2:] if len(text) > 2 else np.zeros(0, bool)
    triple = (raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:])[inside] if len(text) > 2 else np.zeros(0, np.uint64)
    triple = (mixed(triple) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)
    both = np.concatenate([owner << (BITS + 1) | word, (text[:-2][inside] if len(text) > 2 else np.zeros(0, np.int64)) << (BITS + 1) | triple])
    both = np.unique(both)
    with_next = np.flatnonzero(owner[:-1] == owner[1:])
    pair = mixed(words.hash[with_next] * np.uint64(0x9E3779B97F4A7C15) + words.hash[with_next + 1]) >> np.uint64(24)
    pairs, kinds = (np.bincount(x, minlength=len(texts)) for x in (owner[with_next], np.unique(owner[with_next].astype(np.uint64) << np.uint64(40) | pair).astype(np.int64) >> 40))
    return both >> (BITS + 1), both & ((2 << BITS) - 1), 1 - kinds / np.maximum(pairs, 1) * (pairs > 0) - (pairs == 0)


def _odds_of_features(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """Log odds that a good document has a feature, against that a bad one has it, by how many have it."""
    return np.log((good + 0.5) / (n_good + 1) / ((bad + 0.5) / (n_bad + 1))).astype(np.float32)


def _summary(text: np.ndarray, feature: np.ndarray, repeats: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Of each text: its features' mean log odds, that times the square root of their number, the number's logarithm, repeats, 1."""
    n = len(repeats)
    size = np.bincount(text, minlength=n).astype(float)
    total = np.bincount(text, odds[feature], minlength=n)
    return np.stack([total / np.maximum(size, 1), total / np.sqrt(np.maximum(size, 1)) / 10, np.log1p(size) / 5, 3 * repeats, np.ones(n)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        d = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return w


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Classifier:
    odds: np.ndarray
    weights: np.ndarray

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        text, feature, repeats = features(texts)
        return _probability(_summary(text, feature, repeats, self.odds) @ self.weights)


def fit_classifier(rows: DataFrame) -> tuple[Classifier, pd.DataFrame] | None:
    """The classifier of labelled documents (id, y, features, repeats), and each one's evidence by a classifier of the other parts.

    None without both labels. Features are counted by grouped aggregation; counts of the parts and a
    few numbers of each document come to the driver.
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold")
    sizes = rows.groupBy(fold).agg(F.sum("y").alias("good"), F.count("*").alias("n")).collect()
    n = np.zeros((2, FOLDS))
    for r in sizes:
        n[:, r.fold] = r.good, r.n - r.good
    if not n.sum(1).all():
        return None
    table = rows.select(fold, "y", F.explode("features").alias("feature")).groupBy("fold", "feature").agg(F.sum("y").alias("good"), F.count("*").alias("n")).toArrow()
    at, feature, good, every = (table.column(c).to_numpy() for c in ("fold", "feature", "good", "n"))
    count = np.zeros((2, FOLDS, 2 << BITS))
    count[0, at, feature], count[1, at, feature] = good, every - good
    whole, of_all = count.sum(1), n.sum(1)
    all_odds = _odds_of_features(*whole, *of_all)
    others = [_odds_of_features(*(whole - count[:, f]), *(of_all - n[:, f])) if (of_all - n[:, f]).all() else all_odds for f in range(FOLDS)]

    def judge(batches):
        for batch in batches:
            value = batch.column(3).flatten().to_numpy().astype(np.int64)
            size = batch.column(3).value_lengths().to_numpy()
            text = np.repeat(np.arange(batch.num_rows), size)
            folds, repeats = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            x = np.zeros((batch.num_rows, 5))
            for f in np.unique(folds):
                x[folds == f] = _summary(text, value, repeats, others[f])[folds == f]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in x.T)], names=["id", "y", *"abcde"])

    got = rows.select("id", "y", fold, "features", "repeats").mapInArrow(released(judge), f"id {dict(rows.dtypes)['id']}, y double, a double, b double, c double, d double, e double")
    got = got.toPandas().sort_values("id", ignore_index=True)
    x = got[list("abcde")].to_numpy()
    weights = _logistic(x, got["y"].to_numpy())
    return Classifier(all_odds, weights), got[["id", "y"]].assign(evidence=_probability(x @ weights))


def _odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def _strength(groups: DataFrame, prior: str | float) -> float:
    """Weight of the prior by moments: what groups (n, s) vary beyond what their counts explain."""
    prior = F.col(prior) if isinstance(prior, str) else F.lit(prior)
    mean, n = F.col("s") / F.col("n"), F.col("n")
    r = groups.where("n >= 2").agg(F.sum(n).alias("n"), F.sum(n * (mean - prior) ** 2).alias("between"), F.sum(prior * (1 - prior)).alias("within"), F.sum(n * prior * (1 - prior)).alias("noise")).first()
    if not r.n or not r.noise:
        return MOST
    excess = (r.between - r.within) / r.noise
    return float(min(MOST, max(LEAST, 1 / excess - 1))) if excess > 0 else MOST


def site_posteriors(docs: DataFrame) -> tuple[DataFrame, float]:
    """Columns host_mean and path_mean for rows (host, path, n, s), of what the other rows of their sites have shown; and the whole's mean.

    n is what a row counts, s how much of that is for good quality. Sites are summed over all rows;
    a row is taken out of its own sites' sums.
    """
    paths = stored(docs.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "paths")
    total = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    total = 0.5 if total is None else float(total)
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    above = _strength(hosts, total)
    known = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    within = paths.join(small(known, 64), "host").withColumn("prior", (F.col("host_s") + above * total) / (F.col("host_n") + above))
    below = _strength(within, "prior")
    sites = stored(within.select("host", "path", "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s")), "sites")
    least = lambda x: F.greatest(x, F.lit(0.0))
    out = docs.join(small(sites, 128), ["host", "path"])
    out = out.withColumn("host_mean", (least(F.col("host_s") - F.col("s")) + above * total) / (least(F.col("host_n") - F.col("n")) + above))
    out = out.withColumn("path_mean", (least(F.col("path_s") - F.col("s")) + below * F.col("host_mean")) / (least(F.col("path_n") - F.col("n")) + below))
    return out.drop("host_n", "host_s", "path_n", "path_s"), total


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = THRESHOLD, most: int = TRAIN_DOCS) -> DataFrame:
    """Quality of each document, a row for each input row.

    Columns: id, evidence (the classifier's probability), host_mean, path_mean (posteriors of the
    site's other documents), score (0 to 1), kept (score >= threshold). Null texts count as empty,
    null hosts and paths are a site of their own, rows without an id are unlabelled; without labels
    of both kinds the evidence is 1/2 everywhere. Repeated rows stay and count each time; other
    columns are dropped; an empty table gives an empty result. Weights of the evidence and of the
    site are fitted on at most ``most`` labelled documents, none of which is judged by itself.
    """
    prepare(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    given = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit(NONE)).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit(NONE)).alias("path"), F.col(text_col).alias("text"))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    marks = stored(marks, "labels")
    some = stored(marks.orderBy(F.xxhash64("id"), "id").limit(most), "fitted")  # at most ``most`` rows: small

    def read(batches):
        for batch in batches:
            texts = encoded(batch.column(2))
            for a, b in pieces(texts):
                text, feature, repeats = features(texts[a:b])
                ends = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))), pa.array(repeats)], names=["id", "y", "features", "repeats"])

    taken = given.join(F.broadcast(some), "id").select("id", "y", "text").mapInArrow(released(read), f"id {kind}, y double, features array<int>, repeats double")
    fitted = fit_classifier(stored(taken.dropDuplicates(["id"]), "fitted-features"))
    judge = fitted[0] if fitted else None

    def look(batches):
        for batch in batches:
            texts = encoded(batch.column(3))
            found = np.full(len(texts), 0.5)
            if judge:
                for a, b in pieces(texts):
                    found[a:b] = judge(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], names=["id", "host", "path", "evidence"])

    docs = given.mapInArrow(released(look), f"id {kind}, host string, path string, evidence double")
    docs = docs.join(small(marks, 24), "id", "left")
    n = F.when(F.col("y").isNotNull(), 1.0).otherwise(SOFT)
    docs = stored(docs.select("id", "host", "path", "evidence", "y", n.alias("n"), (n * F.coalesce("y", "evidence")).alias("s")), "evidence")
    docs, total = site_posteriors(docs)
    site = _odds(F.col("path_mean")) - _odds(F.lit(total))
    weights = np.array([1.0, 1.0, 0.0])
    if fitted:
        shown = docs.join(F.broadcast(some.select("id")), "id", "left_semi").select("id", site.alias("site")).dropDuplicates(["id"]).toPandas()
        got = fitted[1].merge(shown, on="id")
        p, y = np.clip(got["evidence"].to_numpy(), 1e-6, 1 - 1e-6), got["y"].to_numpy()
        x = np.stack([np.log(p / (1 - p)), got["site"].to_numpy(), np.ones(len(got))], 1)
        weights = _logistic(x, y)
        if weights[1] < 0:  # a good site never speaks against a document
            weights = np.insert(_logistic(x[:, [0, 2]], y), 1, 0.0)
    z = _odds(F.col("evidence")) * float(weights[0]) + site * float(weights[1]) + float(weights[2])
    score = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    return docs.select(F.col("id").alias(id_col), "evidence", "host_mean", "path_mean", score.alias("score")).withColumn("kept", F.col("score") >= threshold)
